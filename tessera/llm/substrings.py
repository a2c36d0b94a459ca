"""Substring dedup by relative Lempel-Ziv parsing.

What is removed: every word covered by a window of ``WINDOW`` consecutive words
whose word sequence also starts earlier in the corpus (at a smaller document id,
or earlier in the same document).  Windows are judged on the input.

How.  Every document is cut into reference blocks that depend on content only:
of the ``ANCHOR``-word sequences inside each window the one with the smallest
hash is the window's anchor (the leftmost of equals), and an anchor's block is
all words that windows around it can reach.  Equal windows have equal anchors
at equal places, so an anchor finds every block that could hold a copy.

1. Index: all blocks, by anchor, hash of the block, document and place.
2. Matches: a block that also starts earlier is copied whole, from where it starts
   first (or from an earlier copy).
3. Boundaries: where a passage begins or ends, its anchor is shared but the block
   around it is not.  For such anchors the windows themselves are looked up, one
   by one, by a 128-bit hash: the first block of each kind takes part, as its later
   copies are settled by step 2.
4. Parse: matches whose sources follow on each other are extended into one; at each
   word, the match that reaches furthest becomes the next factor (start, length,
   source document, source start), and words without one are literals.  Factors are
   parts of matches of ``WINDOW`` words or more; they are the duplicate spans.

An index entry is a few numbers; texts move once, to meet their matches.  Later
copies of a block or window that a worker has met before are settled there and
spread over all partitions (``_Heads``), so of a passage in a third of all
documents about one copy a task travels to its key.  Nor is an anchor hot whose
surroundings differ each time: anchors that are frequent in a sample of the
documents (at most ``HOT_ANCHORS`` of them, the most frequent) are dealt out by
their blocks, and all of their blocks count as boundaries, which is more to look
up but never changes what is found.

Defined results: a null or wordless text has no words and the digest of the
empty text; documents of under ``WINDOW`` words lose nothing; rows that share an
id and text share their spans, rows that share an id only are one document as
far as order goes; a null id precedes all others; an empty table gives an empty
result; a text of any length counts whole; of equal matches the one from the
smaller document, then place, is taken; other columns pass through where documents
are returned, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches, word_list

WINDOW = 20
ANCHOR = 8
HOT_SHARE, HOT_LEAST, HOT_ANCHORS = 128, 40, 1_000_000
HEADS = 50_000
_NULL = -(1 << 63)
#: Odd multipliers of the two independent rolling hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CACHED_WORDS = 100_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k up to n."""
    size = 1 << max(10, (n + 1).bit_length())
    if (base, size) not in _powers:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, b, np.uint64)
            table[0] = 1
            both.append(np.cumprod(table))
        _powers.clear() if len(_powers) > 8 else None
        _powers[base, size] = (both[0], both[1])
    return _powers[base, size]


def rolling(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the sequences h[starts:ends], modulo 2**64."""
    up, down = _power_table(base, len(h))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])))
    return _mixed((sums[ends] - sums[starts]) * down[starts])


def anchors(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """For every window of word hashes ``h``, the place of its anchor."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(h) - anchor + 1)
    keys = rolling(h, at, at + anchor, _BASES[0])
    best, place = keys[:n].copy(), np.arange(n)
    for k in range(1, window - anchor + 1):
        less = keys[k : k + n] < best
        best[less] = keys[k : k + n][less]
        place[less] = k + np.flatnonzero(less)
    return place


def _blocks(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every anchor in use: place, anchor hash, block hash, first and last window that has it."""
    place = anchors(h)
    if not len(place):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [len(place) - 1]))
    used = place[first]
    # what the block holds besides its words: where in it the anchor stands
    block = rolling(h, first, last + WINDOW, _BASES[1]) ^ _mixed((used - first).astype(np.uint64) + np.uint64(1))
    return used, rolling(h, used, used + ANCHOR, _BASES[0]), block, first, last


class _Heads:
    """First places of sequences that a worker met more than once, by two hashes; the ``HEADS`` of largest hash are held."""

    def __init__(self) -> None:
        self.one, self.two = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.doc, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def settle(self, one: np.ndarray, two: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(settled, source document, source place): which sequences also start earlier, here or in a batch before."""
        by = np.lexsort([at, doc, two, one])
        fresh = np.ones(len(by), bool)
        fresh[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
        starts = np.flatnonzero(fresh)
        head = by[starts]
        first_doc, first_at = doc[head].copy(), at[head].copy()
        repeated = np.diff(np.append(starts, len(by))) > 1
        if len(self.one):
            found = np.minimum(np.searchsorted(self.one, one[head]), len(self.one) - 1)
            known = (self.one[found] == one[head]) & (self.two[found] == two[head])
            repeated |= known
            known &= (self.doc[found] < first_doc) | ((self.doc[found] == first_doc) & (self.at[found] < first_at))
            first_doc[known], first_at[known] = self.doc[found[known]], self.at[found[known]]
        source_doc, source_at = np.empty_like(doc), np.empty_like(at)
        run = np.cumsum(fresh) - 1
        source_doc[by], source_at[by] = first_doc[run], first_at[run]
        self._hold(one[head][repeated], two[head][repeated], first_doc[repeated], first_at[repeated])
        return (source_doc != doc) | (source_at != at), source_doc, source_at

    def _hold(self, one: np.ndarray, two: np.ndarray, doc: np.ndarray, at: np.ndarray) -> None:
        one, two, doc, at = (np.concatenate(x) for x in ((one, self.one), (two, self.two), (doc, self.doc), (at, self.at)))
        _, keep = np.unique(one, return_index=True)  # what is new comes first
        self.one, self.two, self.doc, self.at = (x[keep[-HEADS:]] for x in (one, two, doc, at))


def _doc_key(ids: pd.Series) -> np.ndarray:
    return np.array([_NULL if x is None else int(x) for x in ids], np.int64)


def _index(batches: Iterator[pd.DataFrame], hot: np.ndarray) -> Iterator[pd.DataFrame]:
    """Step 1 on texts: one row per block, with its source if it is settled; ``hot`` are the frequent anchors, in order."""
    heads = _Heads()
    for batch in batches:
        parts = []
        for doc, digest, text in zip(_doc_key(batch["doc"]), batch["digest"], batch["text"], strict=True):
            used, anchor, block, first, last = _blocks(word_hashes(word_list(text)))
            if len(used):
                parts.append((anchor, block, np.full(len(used), doc), np.full(len(used), digest), first, last))
        if not parts:
            continue
        anchor, block, doc, digest, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        settled, from_doc, from_at = heads.settle(anchor, block, doc, first)
        frequent = np.isin(anchor, hot) & ~settled
        key = np.where(settled, _mixed(doc.view(np.uint64) * np.uint64(_BASES[0]) + first.astype(np.uint64)), np.where(frequent, _mixed(anchor ^ block), anchor))
        yield pd.DataFrame({
            "anchor": key.view(np.int64), "block": block.view(np.int64), "doc": doc, "digest": digest, "span": (first << 32) | last, "settled": settled, "hot": frequent,
            "from_doc": np.where(settled, from_doc, 0), "from_at": np.where(settled, from_at, 0),
        })


def _boundary_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 3 on texts that have open blocks: one row per window of such a block, with its source if it is settled."""
    heads = _Heads()
    for batch in batches:
        parts = []
        for doc, digest, text, open_at in zip(batch["doc"], batch["digest"], batch["text"], batch["open"], strict=True):
            h = word_hashes(word_list(text))
            at = np.concatenate([np.arange(s >> 32, (s & 0xFFFFFFFF) + 1) for s in open_at])
            parts.append((rolling(h, at, at + WINDOW, _BASES[0]), rolling(h, at, at + WINDOW, _BASES[1]), np.full(len(at), doc), np.full(len(at), digest), at))
        if not parts:
            continue
        a, b, doc, digest, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        settled, from_doc, from_at = heads.settle(a, b, doc, at)
        key = np.where(settled, _mixed(doc.view(np.uint64) * np.uint64(_BASES[1]) + at.astype(np.uint64)), a)
        yield pd.DataFrame({
            "a": key.view(np.int64), "b": b.view(np.int64), "doc": doc, "digest": digest, "at": at, "settled": settled,
            "from_doc": np.where(settled, from_doc, 0), "from_at": np.where(settled, from_at, 0),
        })


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (the id), digest (a hash of the text, telling rows of one id apart), text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("doc"), F.xxhash64(text).alias("digest"), text.alias("text"))


MATCH = "struct<span: long, doc: long, at: long>"


def matches(keyed: DataFrame) -> DataFrame:
    """(doc, digest, copied, open): the blocks that are copied whole, as matches (see ``MATCH``), and those to look into.

    A span is a range of windows, first * 2**32 + last; a match has besides the
    document and place that its first window is copied from.
    """
    kind = "anchor long, block long, doc long, digest long, span long, settled boolean, hot boolean, from_doc long, from_at long"
    none = np.zeros(0, np.uint64)
    sample = keyed.filter(F.pmod(F.col("digest"), F.lit(HOT_SHARE)) == 0).mapInPandas(lambda batches: _index(batches, none), kind)
    counted = sample.filter("NOT settled").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_LEAST)
    found = counted.orderBy(F.desc("n"), "anchor").limit(HOT_ANCHORS).select("anchor").toPandas()
    hot = keyed.sparkSession.sparkContext.broadcast(np.sort(found["anchor"].to_numpy("int64").view(np.uint64)))
    blocks = keyed.mapInPandas(lambda batches: _index(batches, hot.value), kind)
    # one exchange and one sort serve both windows
    in_anchor = Window.partitionBy("anchor").orderBy("block", "doc", "span").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    in_block = Window.partitionBy("anchor", "block").orderBy("doc", "span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = blocks.withColumn("many", F.col("hot") | (F.first("block").over(in_anchor) != F.last("block").over(in_anchor))).withColumns(
        {"doc0": F.first("doc").over(in_block), "at0": F.shiftright(F.first("span").over(in_block), 32)}
    )
    # rows of equal place (equal rows of the table) are not earlier than themselves, and say the same, which counts once
    first = F.shiftright("span", 32)
    copied = F.col("settled") | (F.col("doc") != F.col("doc0")) | (first != F.col("at0"))
    source = [F.when(F.col("settled"), F.col(own)).otherwise(F.col(other)).alias(name) for own, other, name in (("from_doc", "doc0", "doc"), ("from_at", "at0", "at"))]
    judged = ranked.select("doc", "digest", "span", F.struct("span", *source).alias("match"), copied.alias("copied"), "many").filter("copied OR many")
    return judged.groupBy("doc", "digest").agg(
        F.collect_set(F.when(F.col("copied"), F.col("match"))).alias("copied"), F.collect_set(F.when(~F.col("copied"), F.col("span"))).alias("open")
    )


def marked(keyed: DataFrame) -> DataFrame:
    """keyed with ``matches``, an array of ``MATCH``, empty where nothing is copied.

    Texts are dealt out by document once: both joins to them read the same exchange.
    """
    first = materialize(matches(keyed), "matches")
    joined = keyed.join(first, ["doc", "digest"], "left")
    looked = joined.filter(F.size("open") > 0).select("doc", "digest", "text", "open")
    windows = looked.mapInPandas(_boundary_windows, "a long, b long, doc long, digest long, at long, settled boolean, from_doc long, from_at long")
    order = Window.partitionBy("a", "b").orderBy("doc", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = windows.withColumns({"doc0": F.first("doc").over(order), "at0": F.first("at").over(order)}).filter("settled OR doc0 <> doc OR at0 <> at")
    source = [F.when(F.col("settled"), F.col(own)).otherwise(F.col(other)).alias(name) for own, other, name in (("from_doc", "doc0", "doc"), ("from_at", "at0", "at"))]
    again = earlier.select("doc", "digest", F.struct(F.shiftleft("at", 32).bitwiseOR(F.col("at")).alias("span"), *source).alias("match"))
    again = again.groupBy("doc", "digest").agg(F.collect_set("match").alias("more"))
    none = F.array().cast(f"array<{MATCH}>")
    both = F.concat(F.coalesce("copied", none), F.coalesce("more", none))
    return joined.join(again, ["doc", "digest"], "left").withColumn("matches", both)


def parse(found) -> list[tuple[int, int, int, int]]:
    """Step 4: the factors (start, length, source document, source start) of a document, in order, from its matches."""
    if found is None or not len(found):
        return []
    spans, doc, at = (np.array([m[k] for m in found], np.int64) for k in ("span", "doc", "at"))
    first, last = spans >> 32, spans & 0xFFFFFFFF
    # matches of one source document that are shifted alike continue each other
    by = np.lexsort((last, first, first - at, doc))
    first, last, doc, at = first[by], last[by], doc[by], at[by]
    shift = first - at
    # a later start may lie inside a match that reaches further than the one before it
    chain = np.concatenate(([0], np.cumsum((doc[1:] != doc[:-1]) | (shift[1:] != shift[:-1]))))
    wide = int(last.max()) + 2
    reach = np.maximum.accumulate(chain * wide + last) - chain * wide
    new = np.concatenate(([True], (chain[1:] != chain[:-1]) | (first[1:] > reach[:-1] + 1)))
    heads = np.flatnonzero(new)
    start, end, doc, shift = first[heads], np.maximum.reduceat(last, heads) + WINDOW, doc[heads], shift[heads]
    by = np.lexsort((shift, doc, -end, start))
    factors, to, k = [], 0, 0
    order = [(int(start[i]), int(end[i]), int(doc[i]), int(shift[i])) for i in by]
    while k < len(order):
        begin = max(to, order[k][0])
        best = None
        while k < len(order) and order[k][0] <= begin:  # of those that hold this word, the one that reaches furthest
            if order[k][1] > begin and (best is None or order[k][1] > best[1]):
                best = order[k]
            k += 1
        if best is not None:
            factors.append((begin, best[1] - begin, best[2], begin - best[3]))
            to = best[1]
    return factors


def kept_words(text: str | None, found) -> tuple[int, list[bytes]]:
    """(number of words, the words outside the factors of the matches ``found``)."""
    words = word_list(text)
    kept, at = [], 0
    for start, length, *_ in parse(found):
        kept += words[at:start]
        at = start + length
    return len(words), kept + words[at:] if at else words


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, source_doc, source_start): the duplicate spans of every row of ``docs``, in words, and where they are copied from.

    A null source is a document without an id.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, *f) for doc, found in zip(batch["doc"], batch["matches"], strict=True) for f in parse(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "source_doc", "source_start"])

    found = marked(_keyed(docs, id_col, text_col)).filter(F.size("matches") > 0).select("doc", "matches")
    out = found.mapInPandas(run, "doc_id long, start long, length long, source_doc long, source_start long")
    return out.withColumns({c: F.when(F.col(c) != _NULL, F.col(c)) for c in ("doc_id", "source_doc")})


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``."""

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ranges in batches:
            rows = []
            for text, own in zip(texts, ranges, strict=True):
                n, kept = kept_words(text, own)
                rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    small_batches(docs.sparkSession)
    found = marked(_keyed(docs, id_col, text_col)).withColumn("r", of.asNondeterministic()("text", "matches"))
    return found.select(F.when(F.col("doc") != _NULL, F.col("doc")).alias("doc_id"), "r.*")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept words of each text, joined by single spaces.

    Texts that lose nothing are left as they are; documents that lose every word
    go.  Other columns stay as they are, but ``n_chars``, if there is one, is
    the new text's length.
    """

    @F.pandas_udf("string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, ranges in batches:
            out = []
            for text, own in zip(texts, ranges, strict=True):
                if own is None or not len(own):
                    out.append(text)
                    continue
                kept = kept_words(text, own)[1]
                out.append(b" ".join(kept).decode("utf-8", "surrogatepass") if kept else None)
            yield pd.Series(out, dtype=object)

    small_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col(f"row.`{text_col}`")
    own = row.select(F.coalesce(F.col(f"row.`{id_col}`").cast("long"), F.lit(_NULL)).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"), "row")
    ranges = marked(keyed).filter(F.size("matches") > 0).groupBy("doc", "digest").agg(F.first("matches").alias("matches"))
    found = own.join(ranges, ["doc", "digest"], "left").withColumn("new", of.asNondeterministic()(text, "matches"))
    found = found.filter(F.col("new").isNotNull() | F.col("matches").isNull())
    columns = []
    for c in docs.columns:
        col = F.col(f"row.`{c}`")
        if c == text_col:
            col = F.when(F.col("matches").isNull(), col).otherwise(F.col("new"))
        elif c == "n_chars":
            col = F.when(F.col("matches").isNull(), col).otherwise(F.length("new").cast(docs.schema[c].dataType))
        columns.append(col.alias(c))
    return found.select(*columns)
