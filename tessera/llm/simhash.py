"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of
its word shingles.  Two fingerprints are linked if at most ``radius`` bits
differ.  Ball hashing lets every fingerprint emit all variants within half the
radius; linked ones then share a variant.  On the whole 64-bit word with radius
4 that is 2,081 variants each.  With ``blocks=2`` (the default here) the word is
cut in two: linked fingerprints differ in at most half the radius in one of the
halves, so every half emits its variants within half of *that*, 33 each, 66 in
all.  No link is lost for any number of blocks, as candidates are always
verified on the whole fingerprints; ``blocks=1`` is the plain form.  Halves have 32
bits, so unlike fingerprints meet by chance: about n / 8,000,000 of them for each of
n.  From some ten billion distinct fingerprints on that is more than the plain
form's 2,081 variants cost, which then is the one to use.

Only distinct fingerprints emit variants, so exact copies cost nothing.  Rows
that share a variant are compared in a stream over sorted partitions: small runs
in full, larger ones by a search that yields a spanning forest of their links,
never all pairs; the largest ones by balls again, within the run, on the half of
the word that differs most, so time doesn't grow with the square of a run.  Links
then become components by distributed star contraction.

Defined results: a null or wordless text has fingerprint zero and links like any
other; a text with fewer words than a shingle is one shingle, and one of any length
counts whole; equal rows have equal fingerprints, and it doesn't matter which of
equals comes first; null ids never name a component unless it has no other; an
empty table gives an empty result; other columns pass through where a function
returns documents, and are not looked at elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import resemblance
from tessera.llm.common import materialize, small_batches, word_list
from tessera.llm.graph import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 2
SMALL_RUN = 16
LARGE_RUN = 4096
HELD_KEYS = 8_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = word_list(text, lower=True)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    values, ones = np.array(hashes, "<u8"), np.zeros(64, np.int64)
    for i in range(0, len(values), 65_536):
        ones += np.unpackbits(values[i : i + 65_536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of.asNondeterministic()(text)


def variant_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(block, mask): what a fingerprint's blocks are changed by to get its variants."""
    width = 64 // blocks
    reach = radius // blocks // 2 + radius // blocks % 2
    flips = [sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(width), n)]
    return [(block, flip << (block * width)) for block in range(blocks) for flip in flips]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within one run of distinct values."""
    rest, edges = np.arange(len(values)), []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(values[rest] ^ values[at]) <= radius
            found = rest[near].tolist()
            edges += [(at, j) for j in found]
            todo += found
            rest = rest[~near]
    return edges


def _forest_by_balls(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join what ``_forest`` joins, for a large run: linked values share a variant, within half the radius, of either half of the word."""
    halves = [(values >> np.uint64(32)).astype(np.uint32), (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)]
    half = max(halves, key=lambda h: len(np.unique(h)))
    reach = radius // 2 + radius % 2
    masks = np.array([sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(32), n)], np.uint32)
    passes = -(-len(values) * len(masks) // HELD_KEYS)
    edges: set[tuple[int, int]] = set()
    for k in range(passes):
        parts = []
        for mask in masks:
            key = half ^ mask
            mine = np.flatnonzero((key * np.uint32(0x9E3779B1) >> np.uint32(7)) % np.uint32(passes) == k)
            parts.append((key[mine], mine))
        key, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        sizes = np.diff(cut)
        for lag in range(1, SMALL_RUN):
            i = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(i):
                break
            i = i[np.bitwise_count(values[at[i]] ^ values[at[i + lag]]) <= radius]
            edges.update(zip(at[i].tolist(), at[i + lag].tolist(), strict=True))
        for run in np.flatnonzero(sizes > SMALL_RUN):
            own = at[cut[run] : cut[run + 1]]
            edges.update((int(own[a]), int(own[b])) for a, b in _forest(values[own], radius))
    return sorted(edges)


def _links(keys: np.ndarray, values: np.ndarray, radius: int) -> pd.DataFrame:
    """Verified links within whole runs of equal keys; values are unsigned."""
    a, b = [], []
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    sizes = np.diff(cut)
    for lag in range(1, SMALL_RUN):
        i = np.flatnonzero(keys[lag:] == keys[:-lag])
        if not len(i):
            break
        i = i[np.bitwise_count(values[i] ^ values[i + lag]) <= radius]
        a.append(values[i])
        b.append(values[i + lag])
    for run in np.flatnonzero(sizes > SMALL_RUN):
        own = values[cut[run] : cut[run + 1]]
        search = _forest if len(own) <= LARGE_RUN else _forest_by_balls
        edges = np.array(search(own, radius), np.int64).reshape(-1, 2)
        a.append(own[edges[:, 0]])
        b.append(own[edges[:, 1]])
    empty = np.zeros(0, np.uint64)
    found = pd.DataFrame({"a": np.concatenate(a or [empty]).view(np.int64), "b": np.concatenate(b or [empty]).view(np.int64)})
    return found.drop_duplicates()


def links(fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) that join all distinct values of column ``fp`` within ``radius`` bits.

    Within a run of more than ``SMALL_RUN`` values only a spanning forest of its
    links is listed; every link that isn't has its ends connected by others.
    """
    masks = variant_masks(blocks, radius)
    width = 64 // blocks
    keeps = [_signed(((1 << width) - 1) << (k * width)) for k in range(blocks)]
    exprs = [F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseXOR(F.lit(_signed(m))).bitwiseAND(F.lit(keeps[k])).alias("variant")) for k, m in masks]
    if len(exprs) > 200:  # the plain form: a table of masks instead of a long expression
        listed = F.array(*[F.lit(_signed(m)) for _, m in masks])
        spread = fingerprints.select("fp", F.explode(listed).alias("mask")).select("fp", F.lit(0).alias("block"), F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    else:
        spread = fingerprints.select("fp", F.explode(F.array(*exprs)).alias("key")).select("fp", "key.block", "key.variant")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            # one number for block and variant: runs of the sorted stream stay runs
            key = batch["variant"].to_numpy("int64").view(np.uint64) * np.uint64(2 * blocks + 1) + batch["block"].to_numpy("int64").astype(np.uint64)
            held.append((key, batch["fp"].to_numpy("int64").view(np.uint64)))
            if key[-1] == held[0][0][0]:
                continue  # one run so far
            keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            last = len(keys) - int(np.argmax(keys[::-1] != keys[-1]))
            yield _links(keys[:last], values[:last], radius)
            held = [(keys[last:], values[last:])]
        if held:
            yield _links(*(np.concatenate(x) for x in zip(*held, strict=True)), radius)

    return spread.repartition("block", "variant").sortWithinPartitions("block", "variant", "fp").mapInPandas(run, "a long, b long")


def components(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    made = docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp"))
    made = materialize(made, "fingerprints")
    distinct = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(distinct.select("fp"), radius, blocks))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(smallest, "root").select("fp", "component_id")
    return made.join(classes, "fp").select("doc_id", "fp", "component_id")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, similarity: float | None = None
) -> DataFrame:
    """``docs`` with one row per component, that of the smallest id, then fingerprint; and rows without an id.

    Links are fingerprints within ``radius`` bits or, if ``similarity`` is given,
    shingle sets of at least that Jaccard similarity: links of fingerprints are
    candidates there, which the texts verify, beside those of ``resemblance``.
    """
    text = F.col(f"`{text_col}`")
    if similarity is not None:
        return resemblance.deduplicate(docs, shingle, similarity, id_col, text_col, fingerprint_column(text, shingle), lambda fps: links(fps, radius, blocks))
    small_batches(docs.sparkSession)
    made = docs.select(F.col(f"`{id_col}`").alias("id"), resemblance.digest_of(text).alias("digest"), fingerprint_column(text, shingle).alias("key"))
    made = materialize(made, "fingerprints")
    roots = connected_components(links(made.select(F.col("key").alias("fp")).distinct(), radius, blocks))
    return resemblance.keep_first(docs, made, roots.withColumnRenamed("node", "key"), id_col, text_col)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
