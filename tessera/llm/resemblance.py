"""Near-duplicates by exact Jaccard similarity of word shingles.

This is what the SimHash operator does where a similarity is asked for
(``simhash.deduplicate(..., similarity=0.8)``).  Candidates come from its ball
hashing first: texts of equal fingerprints, and those of fingerprints within the
operator's radius.  But a pair at Jaccard 0.8 differs in about 10 of 64 SimHash
bits, which no ball of half the radius reaches, so MinHash adds the candidates
beyond it.  Every link is verified on the texts.

Two texts are linked if their sets of word shingles overlap by at least
``SIMILARITY`` (size of the intersection over that of the union).  A text's sketch
is one byte of each of ``MINIMA`` minima; texts that agree on all ``ROWS`` bytes
of one of ``BANDS`` bands meet.  At the threshold itself 0.9993 of the pairs meet,
above it more.

Only distinct texts (as words, A-Z lower-cased) emit bands, so exact copies cost
nothing.  Texts of a band that few share are paired in full.  Those of a band that
many share are joined to their sketches: first each is paired with the few that
look most like it, and the verified links give components; then every pair whose
ends are still in unlike components is verified too, unless its sketches put its
similarity ``SLACK`` standard deviations below the threshold (as rare as pairs at
the threshold that don't meet).  Links of fingerprints wait for the components,
too, where there is such a band: a crowd of near copies has many more of them than
texts, nearly all within one component.  A pair is listed for the first band it shares
only.  Crowded bands are dealt out in blocks of ``BLOCK`` texts, so neither the
rows nor the comparisons of a task grow with the largest group.

Defined results: null and wordless texts are alike; a text with fewer words than
a shingle is one shingle; a text of any length counts whole; rows without an id
stay; of rows that are the same text under the same id one stays; ties go to the
smaller id, then hash; an empty table gives an empty result; all columns are kept,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches, word_list
from tessera.llm.graph import connected_components

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
BANDS, ROWS = 24, 6
MINIMA = 256
SMALL_RUN = 12
BLOCK = 4096
BEST = 2
SLACK = 3.2

_rng = np.random.default_rng(SEED)
_MASK = _rng.integers(0, 1 << 32, MINIMA, np.uint32)
_FACTOR = _rng.integers(0, 1 << 32, MINIMA, np.uint32) | np.uint32(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = word_list(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    last = max(1, len(words) - shingle + 1)
    return np.array(sorted({xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(last)}), np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the set under each of ``MINIMA`` hash functions."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        mixed = (x[None, i : i + 1024] ^ _MASK[:, None]) * _FACTOR[:, None]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        np.minimum(least, mixed.min(1), out=least)
    return least


def sketch_column(text: Column, shingle: int = SHINGLE) -> Column:
    """Struct of: a number for the words of the text, how many shingles it has, and a byte of each minimum."""

    @F.pandas_udf("key long, n int, code binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        from xxhash import xxh64_intdigest

        rows = []
        for t in texts:
            own = shingle_set(t, shingle)
            if not len(own):
                rows.append((0, 0, b""))
                continue
            key = np.array([xxh64_intdigest(b" ".join(word_list(t, lower=True)), SEED)], np.uint64)
            rows.append((int(key.view(np.int64)[0]), len(own), (minima(own) & np.uint32(255)).astype(np.uint8).tobytes()))
        return pd.DataFrame(rows, columns=["key", "n", "code"])

    return of.asNondeterministic()(text)


def _near_sizes(n: np.ndarray, i, j, similarity: float) -> np.ndarray:
    return np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])


def _run_pairs(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Of a stream sorted by run: the pairs of small runs, and the members of larger ones (with b null).

    No more than one small run is held between batches.
    """
    held, large = None, None
    for batch in batches:
        rows = batch if held is None else pd.concat((held, batch), ignore_index=True)
        if not len(rows):
            continue
        run, key, n, band = (rows[c].to_numpy() for c in ("run", "key", "n", "band"))
        cut = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1], [True])))
        sizes = np.repeat(np.diff(cut), np.diff(cut))
        member = (sizes > SMALL_RUN) | (run == large if large is not None else False)
        last = cut[-2]
        if member[last]:  # it may go on, and what follows of it are members too
            large, held = run[last], None
            done = np.ones(len(run), bool)
        else:
            large, held = None, rows[last:]
            done = np.arange(len(run)) < last
        out = [pd.DataFrame({"a": key[member], "b": None, "run": run[member], "band": band[member]})]
        yield from _small(out, key, n, run, done & ~member, similarity)
    if held is not None and len(held):
        run, key, n = (held[c].to_numpy() for c in ("run", "key", "n"))
        yield from _small([], key, n, run, np.ones(len(run), bool), similarity)


def _small(out: list[pd.DataFrame], key: np.ndarray, n: np.ndarray, run: np.ndarray, use: np.ndarray, similarity: float) -> Iterator[pd.DataFrame]:
    key, n, run = key[use], n[use], run[use]
    for lag in range(1, SMALL_RUN):
        i = np.flatnonzero(run[lag:] == run[:-lag])
        if not len(i):
            break
        i = i[_near_sizes(n, i, i + lag, similarity)]
        out.append(pd.DataFrame({"a": np.minimum(key[i], key[i + lag]), "b": np.maximum(key[i], key[i + lag]), "run": None, "band": None}))
    found = pd.concat(out).astype({"b": "Int64", "run": "Int64", "band": "Int32"}) if out else None
    if found is not None and len(found):
        yield found.drop_duplicates()


def _likeness(code: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    return (code[j] == code[i]).sum(1, dtype=np.int32)


def _first_shared(code: np.ndarray, i: int, j: np.ndarray, band: int) -> np.ndarray:
    """Which of j share no band before ``band`` with i."""
    if not band:
        return np.ones(len(j), bool)
    equal = (code[j, : band * ROWS] == code[i, : band * ROWS]).reshape(len(j), band, ROWS)
    return ~equal.all(2).any(1)


def _least(similarity: float) -> float:
    """The fewest equal bytes of sketches that a pair of the asked similarity is expected to have."""
    return (similarity - SLACK * (similarity * (1 - similarity) / MINIMA) ** 0.5) * MINIMA


def _codes(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)


def _best_pairs(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """(a, b): each text of a block with the ``BEST`` that look most like it."""
    key, n, code = rows["key"].to_numpy(), rows["n"].to_numpy(), _codes(rows)
    found, least = [], _least(similarity)
    for i in range(len(rows)):
        j = np.flatnonzero(_near_sizes(n, i, slice(None), similarity) & (key != key[i]))
        like = _likeness(code, i, j)
        best = np.lexsort((key[j], -like))[:BEST]
        found += [(min(key[i], key[j[k]]), max(key[i], key[j[k]])) for k in best.tolist() if like[k] >= least]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64").drop_duplicates()


def _cross_pairs(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """(a, b) of a block that asks against a block of the same run: ends have unlike roots, sketches may be of similar texts, and no earlier band is shared."""
    key, n, root, asks = (rows[c].to_numpy() for c in ("key", "n", "root", "asks"))
    code, least, band, found = _codes(rows), _least(similarity), int(rows["band"].iloc[0]), []
    for i in np.flatnonzero(asks).tolist():
        j = np.flatnonzero(~asks & (root != root[i]) & _near_sizes(n, i, slice(None), similarity))
        j = j[_likeness(code, i, j) >= least]
        j = j[_first_shared(code, i, j, band)]
        found.append(pd.DataFrame({"a": np.minimum(key[i], key[j]), "b": np.maximum(key[i], key[j])}))
    return pd.concat(found).drop_duplicates() if found else pd.DataFrame({"a": key[:0], "b": key[:0]})


def _verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, text: Column, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(links, pairs): the distinct ``pairs`` (a, b) of keys, and those of them whose texts are as similar as asked."""

    @F.pandas_udf("boolean")
    def similar(one: pd.Series, other: pd.Series) -> pd.Series:
        out, text, own = [], None, shingle_set(None)
        for s, t in zip(one, other, strict=True):
            if s != text:
                text, own = s, shingle_set(s, shingle)
            out.append(jaccard(own, shingle_set(t, shingle)) >= similarity)
        return pd.Series(out, dtype=bool)

    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    named = materialize(ends.join(distinct.select("key", "digest"), "key"), "ends")
    texts = docs.select(digest_of(text).alias("digest"), text.alias("text")).join(named.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    texts = materialize(texts.join(named, "digest").select("key", "text"), "texts")
    one = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("other")), "b")
    both = one.join(texts.select(F.col("key").alias("a"), F.col("text").alias("one")), "a")
    return materialize(both.filter(similar.asNondeterministic()("one", "other")).select("a", "b"), "links"), pairs


def digest_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _ball_pairs(distinct: DataFrame, links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(a, b) of texts whose fingerprints are equal or linked: each with the first of its fingerprint, and the first ones of linked fingerprints.

    If ``roots`` (key, root) are given, pairs whose ends they join already are left out.
    Near fingerprints share many variants, so their link is listed many times.
    """
    own = distinct.select("fp", "key")
    own = own.withColumn("root", F.col("key")) if roots is None else own.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = materialize(own.groupBy("fp").agg(F.min(F.struct("key", "root")).alias("at")).select("fp", F.col("at.key").alias("first"), F.col("at.root").alias("top")), "balls")
    equal = own.join(first, "fp").filter("root <> top").select(F.col("first").alias("a"), F.col("key").alias("b"))
    end = lambda fp, key, top: first.select(F.col("fp").alias(fp), F.col("first").alias(key), F.col("top").alias(top))
    ends = links.distinct().join(end("a", "one", "one_top"), "a").join(end("b", "other", "other_top"), "b").filter("one_top <> other_top")
    return equal.unionByName(ends.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")))


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots`` (key, root) after the links ``more`` (a, b) as well, of which only those between unlike components count."""
    if not more.head(1):
        return roots
    top = lambda end: roots.select(F.col("key").alias(end), F.col("root").alias(f"{end}_root"))
    between = more.join(top("a"), "a", "left").join(top("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    tops = connected_components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(tops, "root", "left").select("key", F.coalesce("top", "root").alias("root"))
    new = tops.join(roots.select(F.col("key").alias("root")), "root", "left_anti").select(F.col("root").alias("key"), F.col("top").alias("root"))
    return moved.unionByName(new)


def classes(
    made: DataFrame, docs: DataFrame, text: Column, shingle: int = SHINGLE, similarity: float = SIMILARITY, balls: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(key, root) of the distinct texts that have a link; ``made`` has digest, key, n, code and fp of the rows of ``docs``.

    ``balls`` gives the links (a, b) of a column ``fp`` of fingerprints.
    """
    own = [F.first("fp").alias("fp")] if balls else []
    distinct = made.filter("n > 0").groupBy("key").agg(F.min("digest").alias("digest"), F.first("n").alias("n"), F.first("code").alias("code"), *own)
    distinct = materialize(distinct, "distinct")
    at = lambda j: F.struct(j.alias("band"), F.xxhash64(j, F.substring("code", j * ROWS + 1, F.lit(ROWS))).alias("run"))
    spread = distinct.select("key", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), at)).alias("at")).select("at.run", "at.band", "key", "n")
    sorted_runs = spread.repartition("run").sortWithinPartitions("run", "key")
    found = materialize(sorted_runs.mapInPandas(lambda b: _run_pairs(b, similarity), "a long, b long, run long, band int"), "candidates")
    pairs = found.filter("b IS NOT NULL").select("a", "b")
    near = balls(distinct.select("fp").distinct()) if balls else None
    crowd = found.filter("b IS NULL").select("run", "band", F.col("a").alias("key"))
    if not crowd.head(1):
        pairs = pairs.unionByName(_ball_pairs(distinct, near)) if balls else pairs
        return connected_components(_verified(pairs, distinct, docs, text, shingle, similarity)[0]).withColumnRenamed("node", "key")
    blocks = materialize(crowd.groupBy("run").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "runs")
    crowd = materialize(crowd.join(blocks, "run").join(distinct.select("key", "n", "code"), "key"), "crowd")
    best = crowd.withColumn("block", F.pmod("key", "blocks")).groupBy("run", "block").applyInPandas(lambda rows: _best_pairs(rows, similarity), "a long, b long")
    links, seen = _verified(pairs.unionByName(best), distinct, docs, text, shingle, similarity)
    roots = materialize(connected_components(links).withColumnRenamed("node", "key"), "roots")
    rest = crowd.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    held = materialize(rest.groupBy("run", "root").agg(F.count("*").alias("n")), "held")
    most = held.groupBy("run").agg(F.max(F.struct("n", "root"))["root"].alias("largest"), F.count("*").alias("roots")).filter("roots > 1").select("run", "largest")
    rest = rest.join(materialize(most, "largest"), "run").withColumns({"own": F.pmod("key", "blocks"), "every": F.sequence(F.lit(0), F.col("blocks") - 1)})
    # the texts of a run's largest component don't ask; every block that asks meets every block, and texts go to the blocks that ask only
    columns = ["run", "band", "key", "n", "root", "code"]
    asking = rest.filter("root <> largest").select(*columns, F.lit(True).alias("asks"), F.col("own").alias("one"), F.explode("every").alias("other"))
    asked = rest.join(rest.filter("root <> largest").groupBy("run").agg(F.collect_set("own").alias("ones")), "run")
    asked = asked.select(*columns, F.lit(False).alias("asks"), F.explode("ones").alias("one"), F.col("own").alias("other"))
    cross = asking.unionByName(asked).groupBy("run", "one", "other").applyInPandas(lambda rows: _cross_pairs(rows, similarity), "a long, b long")
    cross = cross.unionByName(_ball_pairs(distinct, near, roots)) if balls else cross
    more = _verified(cross.distinct().join(seen, ["a", "b"], "left_anti"), distinct, docs, text, shingle, similarity)[0]
    return _joined(roots, more)


def keep_first(docs: DataFrame, made: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of ``docs`` one row per component of keys, that of the smallest id, then key; and all rows without an id.

    ``made`` has (id, digest, key) of every row, ``roots`` (key, root) of the keys that have links.
    """
    own = made.filter("id IS NOT NULL").select("id", "key", "digest").join(roots, "key", "left")
    first = own.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(F.struct("id", "key", "digest")).alias("at"))
    first = materialize(first.select("at.id", "at.digest"), "first")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).withColumns({"id": F.col(f"doc.`{id_col}`"), "digest": digest_of(F.col(f"doc.`{text_col}`"))})
    kept = row.filter("id IS NOT NULL").join(first, ["id", "digest"], "left_semi")
    if made.filter("id IS NOT NULL").groupBy("id", "digest").count().filter("count > 1").head(1):
        kept = kept.dropDuplicates(["id", "digest"])
    return kept.select("doc.*").unionByName(row.filter("id IS NULL").select("doc.*"))


def deduplicate(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
    fingerprint: Column | None = None, balls: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``docs`` with one row per component, that of the smallest id, and rows without an id.

    ``fingerprint`` of a row and ``balls`` (see ``classes``) are the SimHash operator's.
    """
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    made = docs.select(F.col(f"`{id_col}`").alias("id"), digest_of(text).alias("digest"), sketch_column(text, shingle).alias("sketch"), *([] if fingerprint is None else [fingerprint.alias("fp")]))
    made = materialize(made.select("id", "digest", "sketch.*", *([] if fingerprint is None else ["fp"])), "sketches")
    return keep_first(docs, made, classes(made, docs, text, shingle, similarity, balls), id_col, text_col)
