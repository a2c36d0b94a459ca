"""Block-max postings: BM25 top-k that reads only blocks which may hold a result.

The index has a row per (term, block of documents): the contribution of the term to
the score of each document of the block, and the largest of them.  Blocks hold about
``BLOCK_DOCS`` documents of similar length, so their largest contributions tell them
apart.  A search adds up the largest contributions by query and block, which bounds
every score in the block, scores the ``LEAD`` most promising blocks, takes the k-th
score found there as the bar, and then scores those other blocks alone whose bound
reaches the bar.  The result is that of scoring everything.

Ids are distinct; a null or empty content has no postings and is found by no query (a
null one counts as a document, but not in the mean length); a query without known
terms finds nothing; equal scores go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.batches import ship
from tessera.functions.text import tokens
from tessera.operators.bm25 import K1, B

BLOCK_DOCS = 128
BUCKETS = 16
LEAD = 4
HOT_DOCS = 2048
#: Tokens of the blocks that are inverted at a time, and of the postings laid in order at a time; rows of the index handed on at a time.
SET_TOKENS, SLICE_TOKENS, OUT_ROWS = 1_000_000, 2_000_000, 20_000
#: Scores are rounded to six digits; bounds have to clear the bar by less than that.
SLACK = 2e-6


def length_class(length: Column) -> Column:
    """Classes of similar length: number of binary digits, and the two after the first."""
    digits = F.bin(length)
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.lit("-"), F.substring(digits, 2, 2))


def hashed(value: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of an MD5 as a number."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, digits), 16, 10).cast("long")


def bucket_of(term: Column, buckets: int) -> Column:
    return (hashed(term, 4) % buckets).cast("int")


def _pairs(words: pa.Array, dl: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms; and for each term of a text, in order of terms and texts: which of ``terms``, which text, how often) of texts of ``dl`` words."""
    lengths = dl.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    # an empty text has no words, and splits into one
    held, texts = pc.split_pattern(words.filter(pc.greater(dl, 0)), " ").flatten().dictionary_encode(), max(1, len(lengths))
    key = held.indices.to_numpy(zero_copy_only=False).astype(np.int64) * texts + np.repeat(np.arange(len(lengths)), lengths)
    key.sort()
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return held.dictionary, key[starts] // texts, key[starts] % texts, np.diff(starts, append=len(key))


def _moved(counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where the elements of runs of lengths ``counts`` come from when the runs are put into ``order``."""
    first, new = np.cumsum(counts) - counts, counts[order]
    return np.repeat(first[order] - (np.cumsum(new) - new), new) + np.arange(new.sum())


def _lists(ends: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, pa.int32()))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, term, n, dl): documents and tokens by length class, and documents by term, of each batch of (class, dl, words)."""
    for batch in batches:
        classes = pa.table({"class": batch.column("class"), "dl": batch.column("dl")}).group_by("class").aggregate([([], "count_all"), ("dl", "sum")])
        terms, term, _, _ = _pairs(batch.column("words"), batch.column("dl"))
        nothing = pa.nulls(len(terms), pa.string())
        yield pa.RecordBatch.from_pydict({"class": classes.column("class").combine_chunks(), "term": pa.nulls(len(classes), pa.string()), "n": classes.column("count_all").combine_chunks(), "dl": classes.column("dl_sum").combine_chunks()})
        yield pa.RecordBatch.from_pydict({"class": nothing, "term": terms, "n": pa.array(np.bincount(term, minlength=len(terms)), pa.int64()), "dl": nothing.cast(pa.int64())})


def _buckets(terms: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each term, as ``bucket_of`` has it; further digits of its hash)."""
    hashes = b"".join(md5(t).digest()[:6] for t in terms.cast(pa.binary()).to_numpy(zero_copy_only=False))
    digits = np.frombuffer(hashes, [("first", ">u2"), ("more", ">u4")])
    return digits["first"].astype(np.int64) % buckets, digits["more"].astype(np.int64)


def _inverted(hot: list[str], buckets: int, slices: int, hot_slices: list[int]):
    """(bucket, slice, class, terms, shards, counts, ids, tfs, dls): the postings of a set of blocks in a slice are a row, in which ``counts`` of ``ids`` belong to a term and the block of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts, terms, term, doc, tf = 0, [], [], [], [], []
        for batch in batches:
            found = _pairs(batch.column("words"), batch.column("dl"))
            term.append(found[1] + sum(map(len, terms)))
            terms.append(found[0])
            doc.append(found[2] + seen)
            tf.append(found[3])
            texts.append(batch.select(["class", "shard", "id", "dl"]))
            seen += batch.num_rows
        held, texts = pa.concat_arrays(terms).dictionary_encode(), pa.Table.from_batches(texts)
        if not len(held):
            return
        ranked = pc.sort_indices(texts, [("shard", "ascending"), ("id", "ascending")])
        length_class, shard, ids, dl = (texts.column(c).combine_chunks().take(ranked) for c in ("class", "shard", "id", "dl"))
        names, shard, dl, term = held.dictionary, shard.to_numpy(), dl.to_numpy(zero_copy_only=False), held.indices.to_numpy()[np.concatenate(term)].astype(np.int64)
        doc = np.argsort(ranked)[np.concatenate(doc)]
        pairs = np.argsort(term * seen + doc)
        term, doc, tf = term[pairs], doc[pairs], np.concatenate(tf)[pairs]
        starts = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(shard[doc], prepend=-1) != 0))
        counts, term, shard = np.diff(starts, append=len(term)), term[starts], shard[doc[starts]]
        bucket, part = (x[term] for x in _buckets(names, buckets))
        part %= slices
        # which blocks of a common term go together is as good as random
        spread = pc.is_in(names, value_set=pa.array(hot, pa.string())).to_numpy(zero_copy_only=False)[term]
        part[spread] = -1 - (shard[spread] * 2654435761 + crc32(length_class[0].as_py().encode())) % 2**32 % np.array(hot_slices)[bucket[spread]]
        order = np.lexsort((part, bucket))
        pairs = _moved(counts, order)
        bucket, part, counts, doc = bucket[order], part[order], counts[order], doc[pairs]
        rows = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(part, prepend=0) != 0))
        ends = np.append(rows, len(order))
        far = np.concatenate(([0], np.cumsum(counts)))[ends]
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(bucket[rows], pa.int32()), "slice": pa.array(part[rows], pa.int64()), "class": length_class.slice(0, 1).take(pa.array(np.zeros(len(rows), np.int64))),
            "terms": _lists(ends, names.take(pa.array(term[order]))), "shards": _lists(ends, shard[order]), "counts": _lists(ends, counts), "ids": _lists(far, ids.take(pa.array(doc))), "tfs": _lists(far, tf[pairs]), "dls": _lists(far, dl[doc]),
        })

    return run


def _laid(hot: dict[str, int], n: int, avgdl: float):
    """The rows of the index in a slice of a bucket, from the rows of ``_inverted``, in order of terms and blocks."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        flat = lambda name: table.column(name).combine_chunks().flatten()
        held, counts, shard, classes = flat("terms").dictionary_encode(), flat("counts").to_numpy().astype(np.int64), flat("shards").to_numpy().astype(np.int64), table.column("class").combine_chunks().dictionary_encode()
        names, term = held.dictionary, held.indices.to_numpy()
        block = np.repeat(classes.indices.to_numpy(), pc.list_value_length(table.column("terms")).to_numpy()) * (shard.max() + 1) + shard
        block, at = np.unique(block, return_inverse=True)
        blocks = pc.binary_join_element_wise(classes.dictionary.take(pa.array(block // (shard.max() + 1))), pa.array(block % (shard.max() + 1)).cast(pa.string()), "-")
        # a term of a slice that takes all blocks is here as a whole
        df = np.array([hot[t] for t in names.to_pylist()]) if key[1].as_py() < 0 else np.bincount(term, counts).astype(np.int64)
        places = lambda values: np.argsort(pc.sort_indices(values).to_numpy())
        order = np.argsort(places(names)[term] * len(blocks) + places(blocks)[at])
        pairs = _moved(counts, order)
        term, counts = term[order], counts[order]
        df, tf, dl = df[term], flat("tfs").to_numpy()[pairs], flat("dls").to_numpy()[pairs]
        parts = np.repeat(np.log(1.0 + (n - df + 0.5) / (df + 0.5)), counts) * (tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * dl / avgdl)))
        starts = np.cumsum(counts) - counts
        ends = np.append(starts, len(parts))
        rows = pa.RecordBatch.from_pydict({
            "bucket": pa.array(np.full(len(order), key[0].as_py()), pa.int32()), "term": names.take(pa.array(term)), "block": blocks.take(pa.array(at[order])), "df": pa.array(df), "docs": pa.array(counts),
            "top": pa.array(np.maximum.reduceat(parts, starts)), "ids": _lists(ends, flat("ids").take(pa.array(pairs))), "parts": _lists(ends, pa.array(parts)),
        })
        return pa.Table.from_batches([rows.slice(a, OUT_ROWS) for a in range(0, rows.num_rows, OUT_ROWS)])

    return run


def worded(docs: DataFrame) -> DataFrame:
    """(id, dl, words) of ``docs`` (id, content): the number of a text's tokens, and the tokens with a space between them; null where the content is."""
    split = docs.select("id", tokens(F.col("content")).alias("w"))
    return split.select("id", F.when(F.col("w").isNotNull(), F.size("w")).alias("dl"), F.array_join("w", " ").alias("words"))


def build(docs: DataFrame, block_docs: int = BLOCK_DOCS, buckets: int = BUCKETS, hot_docs: int = HOT_DOCS) -> DataFrame:
    """The index of ``docs`` (id, content), see ``inverted``."""
    return inverted(worded(docs), block_docs, buckets, hot_docs)


def inverted(texts: DataFrame, block_docs: int = BLOCK_DOCS, buckets: int = BUCKETS, hot_docs: int = HOT_DOCS) -> DataFrame:
    """(bucket, term, block, df, docs, top, ids, parts) of ``texts`` (id, dl, words), in order of terms within buckets.

    ``parts`` are the term's contributions to the scores of ``ids``, ``top`` is the
    largest.  Documents of a length class are dealt to as many blocks as it needs.  A
    first pass over the texts, which runs here, takes the sizes of the classes and the
    terms of over ``hot_docs`` documents and a hundredth of all, which are at most a
    hundred times a document's; the driver holds no more.  Then documents are exchanged
    by sets of blocks with some ``SET_TOKENS``, and a set's postings once more by slice
    of a bucket, a row of arrays for each.  A slice has all of a term's rows and
    counts them, or, of the terms found before, those of some of the blocks; there are
    so many slices that each gets about ``SLICE_TOKENS``.
    """
    ship(texts.sparkSession)
    held, n = texts.withColumn("class", length_class(F.col("dl").cast("long"))), texts.count()
    found = held.select("class", F.col("dl").cast("long").alias("dl"), "words").mapInArrow(_sizes, "class string, term string, n long, dl long").groupBy("class", "term")
    found = found.agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).filter(F.col("term").isNull() | ((F.col("n") > hot_docs) & (F.col("n") * 100 > n))).collect()
    classes = [r for r in found if r["term"] is None]
    hot = {r["term"]: r["n"] for r in found if r["term"] is not None}
    size, sized = sum(r["dl"] or 0 for r in classes), sum(r["n"] for r in classes if r["class"] is not None)
    warm = np.zeros(buckets, np.int64)
    if hot:
        np.add.at(warm, _buckets(pa.array(hot), buckets)[0], list(hot.values()))
    slices = -(-max(1, size - sum(hot.values())) // (buckets * SLICE_TOKENS))
    # blocks of a class, and how many of them go together; a null content has no class, and its block's name is in no row
    dealt = {r["class"] or "": (-(-r["n"] // block_docs), max(1, SET_TOKENS * r["n"] // (block_docs * max(1, r["dl"] or 0)))) for r in classes} or {"": (1, 1)}
    of_class = lambda k: F.element_at(F.create_map(*[F.lit(x) for c, v in dealt.items() for x in (c, v[k])]), F.coalesce("class", F.lit("")))
    placed = held.withColumn("shard", hashed(F.col("id")) % of_class(0))
    placed = placed.select(F.concat_ws("-", "class", F.floor(F.col("shard") / of_class(1)).cast("string")).alias("blocks"), "class", "shard", "id", "dl", "words")
    ids = texts.schema["id"].dataType.simpleString()
    parts = placed.groupBy("blocks").applyInArrow(
        _inverted(list(hot), buckets, slices, (-(-np.maximum(warm, 1) // SLICE_TOKENS)).tolist()),
        f"bucket int, slice long, class string, terms array<string>, shards array<int>, counts array<int>, ids array<{ids}>, tfs array<int>, dls array<int>",
    )
    rows = parts.groupBy("bucket", "slice").applyInArrow(_laid(hot, n, size / max(1, sized)), f"bucket int, term string, block string, df long, docs long, top double, ids array<{ids}>, parts array<double>")
    return rows.sortWithinPartitions("bucket", "term", "block")


def write(index: DataFrame, path: str) -> None:
    """The index of ``build`` as files by bucket, each in order of terms: a term is in one of them, and a hot one in several."""
    index.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)


def bounds(index: DataFrame, queries: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, block, bound): what no score of the block exceeds; ``ids`` and ``parts`` are not read."""
    return _wanted(index, asked(queries, buckets)).groupBy("query_id", "block").agg(F.sum("top").alias("bound"))


def asked(queries: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, bucket, term): the distinct terms of ``queries`` (query_id, text)."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    return terms.select("query_id", bucket_of(F.col("term"), buckets).alias("bucket"), "term")


def _wanted(index: DataFrame, terms: DataFrame) -> DataFrame:
    return index.join(terms, ["bucket", "term"])


def _scores(index: DataFrame, terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, id, score) of the documents in ``blocks`` (query_id, block)."""
    rows = _wanted(index, terms).join(blocks, ["query_id", "block"], "left_semi")
    pairs = rows.select("query_id", F.explode(F.arrays_zip("ids", "parts")).alias("p"))
    return pairs.groupBy("query_id", F.col("p.ids").alias("id")).agg(F.round(F.sum("p.parts"), 6).alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def plan(index: DataFrame, queries: DataFrame, k: int, lead: int = LEAD, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(scores of the leading blocks, (query_id, block, chosen) for all others): which of them reach the bar."""
    terms, bounded = asked(queries, buckets), bounds(index, queries, buckets)
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    leading = bounded.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= lead).select("query_id", "block")
    first = _scores(index, terms, leading)
    bar = _best(first, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    others = bounded.join(leading, ["query_id", "block"], "left_anti").join(bar, "query_id", "left")
    return first, others.select("query_id", "block", (F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - SLACK)).alias("chosen"))


def top(index: DataFrame, queries: DataFrame, k: int, lead: int = LEAD, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, id, score, rank): the k best documents for every row of ``queries`` (query_id, text)."""
    first, others = plan(index, queries, k, lead, buckets)
    rest = _scores(index, asked(queries, buckets), others.filter("chosen"))
    return _best(first.unionByName(rest), k)


def skipped(index: DataFrame, queries: DataFrame, k: int, lead: int = LEAD, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, blocks, skipped): how many blocks have a term of the query, and how many of them a search passes over."""
    _, others = plan(index, queries, k, lead, buckets)
    passed = others.groupBy("query_id").agg(F.sum((~F.col("chosen")).cast("long")).alias("skipped"))
    every = bounds(index, queries, buckets).groupBy("query_id").agg(F.count("*").alias("blocks"))
    return every.join(passed, "query_id", "left").select("query_id", "blocks", F.coalesce("skipped", F.lit(0)).alias("skipped"))
