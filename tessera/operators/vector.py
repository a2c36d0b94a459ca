"""Vector ranking: exact cosine top-k, batches of queries, and LSH candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.batches import small_batches
from tessera.functions.vectors import as_double, cosine, dot, norm

HASHES, HASH_BITS = 16, 6
#: Vectors and queries of one product of matrices.
SET_VECTORS, SET_QUERIES = 2048, 512


def guarded(vectors: DataFrame, dimension: int) -> DataFrame:
    """``vectors`` (id, vector); fails where a vector has another length."""
    wrong = F.concat(F.lit(f"expected a vector of {dimension} numbers, got "), F.size("vector").cast("string"))
    return vectors.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector")).otherwise(F.raise_error(wrong)))


def query_vector(values) -> Column:
    """A query vector as a constant."""
    return F.array(*[F.lit(float(x)) for x in values])


def scores(vectors: DataFrame, query: Column) -> DataFrame:
    """(id, score): cosine similarity to the query, in double precision."""
    return vectors.select("id", F.round(cosine(as_double(F.col("vector")), query), 6).alias("score"))


def top(vectors: DataFrame, query: Column, k: int) -> DataFrame:
    """The k rows closest by cosine, ties by id: each task keeps k, the driver merges."""
    return scores(vectors, query).orderBy(F.desc("score"), "id").limit(k)


def _gathered(rows: DataFrame, name: str, most: int) -> DataFrame:
    """(ids, flat, keys): rows (id, v, key) in sets of about ``most``, dealt by hash, in order of id; ``flat`` are their vectors end to end."""
    count = rows.agg(F.greatest(F.ceil(F.count("*") / most), F.lit(1)).alias("sets"))
    dealt = rows.crossJoin(F.broadcast(count)).withColumn("at", F.pmod(F.xxhash64("id"), F.col("sets")))
    held = dealt.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("id", "v", "key"))).alias("h"))
    return held.select(F.col("h.id").alias(f"{name}_ids"), F.flatten("h.v").alias(f"{name}_flat"), F.flatten("h.key").alias(f"{name}_keys"))


def _nearest(k: int):
    """For every set of vectors and set of queries the k best of each query, by score in six digits, ties to the first; pairs without a like key are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, qids = batch.column("v_ids")[i].values, batch.column("q_ids")[i].values
                v, v_keys = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1) for c in ("v_flat", "v_keys"))
                q, q_keys = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(len(qids), -1) for c in ("q_flat", "q_keys"))
                s = (v @ q.T) / np.outer(np.sqrt((v * v).sum(1)), np.sqrt((q * q).sum(1)))
                near = np.floor(s * 1e6 + 0.5)
                if v_keys.shape[1]:
                    met = np.zeros(s.shape, bool)
                    for t in range(v_keys.shape[1]):
                        unlike = v_keys[:, t, None] ^ q_keys[None, :, t]
                        met |= (unlike & (unlike - 1)) == 0  # at most one bit
                    near[~met] = -np.inf
                least = min(k, len(ids))
                bar = np.partition(near, len(ids) - least, axis=0)[len(ids) - least]
                at, to = np.nonzero((near >= bar) & (near > -np.inf))
                order = np.lexsort((at, -near[at, to], to))
                at, to = at[order], to[order]
                keep = np.arange(len(to)) - np.searchsorted(to, to) < k
                at, to = at[keep], to[keep]
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(to)), ids.take(pa.array(at)), pa.array(s[at, to])], names=["query_id", "id", "s"])

    return run


def _met(vectors: DataFrame, queries: DataFrame, k: int, key=None) -> DataFrame:
    """(query_id, id, score) that hold the k best of every query (query_id, q) among ``vectors`` (id, v), by cosine.

    Vectors and queries go into sets, and each set meets each other as one product of
    matrices in a task, which hands on k rows a query: the vectors themselves and those
    rows are all that is shuffled.  All have one length and a direction.
    """
    small_batches(vectors.sparkSession)
    key = key or (lambda v: F.array().cast("array<int>"))
    v = _gathered(vectors.select("id", "v", key(F.col("v")).alias("key")), "v", SET_VECTORS)
    q = _gathered(queries.select(F.col("query_id").alias("id"), F.col("q").alias("v"), key(F.col("q")).alias("key")), "q", SET_QUERIES)
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    found = v.crossJoin(q).mapInArrow(_nearest(k), f"query_id {kinds[0]}, id {kinds[1]}, s double")
    return found.select("query_id", "id", F.round("s", 6).alias("score"))


def _sound(v: Column, dimension: Column) -> Column:
    """Whether a vector has so many numbers, all of them finite, and a direction."""
    n = norm(v)
    return F.coalesce((F.size(v) == dimension) & (n > 1e-100) & (n < 1e100), F.lit(False))


def batch_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) for each of a stated set of ``queries`` (query_id, query).

    Sound vectors meet in sets (``_met``); the pairs of all others, whose score is null
    or NaN, are computed one by one.
    """
    q = queries.select("query_id", as_double(F.col("query")).alias("q"))
    v = vectors.select("id", as_double(F.col("vector")).alias("v"))
    longest = F.broadcast(q.agg(F.max(F.size("q")).alias("dimension")))
    q = q.crossJoin(longest).select("query_id", "q", _sound(F.col("q"), F.col("dimension")).alias("q_sound"))
    v = v.crossJoin(longest).select("id", "v", _sound(F.col("v"), F.col("dimension")).alias("v_sound"))
    pairs = lambda v, q: v.crossJoin(q).select("query_id", "id", F.round(cosine(F.col("v"), F.col("q")), 6).alias("score"))
    met = _met(v.filter("v_sound"), q.filter("q_sound"), k).unionByName(pairs(v.filter("NOT v_sound"), q)).unionByName(pairs(v.filter("v_sound"), q.filter("NOT q_sound")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def lsh_model(dimension: int, tables: int = HASHES, bits: int = HASH_BITS, seed: int = 17) -> list[list[list[float]]]:
    """Random hyperplanes, by table and bit."""
    import random

    rng = random.Random(seed)
    return [[[rng.gauss(0, 1) for _ in range(dimension)] for _ in range(bits)] for _ in range(tables)]


def lsh_signatures(vector: Column, model) -> Column:
    """Array of (table, bucket): on which side of each table's hyperplanes the vector lies.

    The hyperplanes are one constant, so the expression stays small.
    """
    nested = lambda x: f"array({', '.join(map(nested, x))})" if isinstance(x, list) else f"{x!r}D"
    planes = F.expr(nested(model))
    sides = lambda table: F.transform(table, lambda plane: (dot(vector, plane) >= 0).cast("int"))
    bucket = lambda table: F.aggregate(sides(table), F.lit(0), lambda total, side: total * 2 + side)
    return F.transform(planes, lambda table, k: F.struct(k.alias("table"), bucket(table).alias("bucket")))


def near_buckets(bucket: Column, bits: int) -> Column:
    """The bucket itself and those that differ from it in one bit."""
    return F.array(bucket, *[bucket.bitwiseXOR(F.lit(1 << b)) for b in range(bits)])


def lsh_top(vectors: DataFrame, queries: DataFrame, k: int, dimension: int, model=None) -> DataFrame:
    """(query_id, id, score, rank) among rows in the query's bucket, or one a bit away, in some table.

    Sound vectors are compared with the queries in sets, buckets first (``_met``): on
    vectors without structure most pairs share a bucket, so pairs are not shuffled.
    """
    model = model or lsh_model(dimension)
    v = vectors.select("id", as_double(F.col("vector")).alias("v")).withColumn("v_sound", _sound(F.col("v"), F.lit(dimension)))
    q = queries.select("query_id", as_double(F.col("query")).alias("q")).withColumn("q_sound", _sound(F.col("q"), F.lit(dimension)))
    buckets = lambda x: F.transform(lsh_signatures(x, model), lambda at: at["bucket"])
    met = _met(v.filter("v_sound"), q.filter("q_sound"), k, buckets)
    met = met.unionByName(_lsh_pairs(v.filter("NOT v_sound"), q, model)).unionByName(_lsh_pairs(v.filter("v_sound"), q.filter("NOT q_sound"), model))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def _lsh_pairs(v: DataFrame, q: DataFrame, model) -> DataFrame:
    """(query_id, id, score) of the pairs that meet in some table, by joins."""
    v_at = v.select("id", F.explode(lsh_signatures(F.col("v"), model)).alias("at"))
    own = q.select("query_id", F.explode(lsh_signatures(F.col("q"), model)).alias("own"))
    probed = own.select("query_id", "own.table", F.explode(near_buckets(F.col("own.bucket"), len(model[0]))).alias("bucket"))
    q_at = probed.select("query_id", F.struct("table", "bucket").alias("at"))
    # only ids meet in buckets; vectors join the distinct pairs
    met = v_at.join(q_at, "at").select("query_id", "id").distinct().join(q, "query_id").join(v, "id")
    return met.select("query_id", "id", F.round(cosine(F.col("v"), F.col("q")), 6).alias("score"))


def signature_rows(vectors: DataFrame, dimension: int, model=None) -> DataFrame:
    """(tbl, bucket, id): the index of ``lsh_candidates`` over ``vectors`` (id, vector)."""
    model = model or lsh_model(dimension)
    rows = vectors.select("id", F.explode(lsh_signatures(as_double(F.col("vector")), model)).alias("at"))
    return rows.select(F.col("at.table").alias("tbl"), F.col("at.bucket").alias("bucket"), "id")


def lsh_buckets(values, model) -> list[tuple[int, int]]:
    """(table, bucket) of a query vector's own buckets and of those that differ in one bit."""
    out = []
    for table, planes in enumerate(model):
        bucket = 0
        for plane in planes:
            bucket = 2 * bucket + (sum(a * b for a, b in zip(plane, values, strict=True)) >= 0)
        out += [(table, bucket), *((table, bucket ^ (1 << bit)) for bit in range(len(planes)))]
    return out


def lsh_candidates(signatures: DataFrame, values, dimension: int, model=None) -> DataFrame:
    """(id) of the stored vectors that share a bucket with a query, or lie one bit away; the buckets are pushed into the scan."""
    model = model or lsh_model(dimension)
    by_table: dict[int, list[int]] = {}
    for table, bucket in lsh_buckets([float(x) for x in values], model):
        by_table.setdefault(table, []).append(bucket)
    wanted = [(F.col("tbl") == table) & F.col("bucket").isin(buckets) for table, buckets in by_table.items()]
    return signatures.filter(reduce(lambda a, b: a | b, wanted)).select("id").distinct()


def hash_embedding(docs: DataFrame, dimension: int) -> DataFrame:
    """(id, bucket, weight): the hashing embedder's sparse vectors of ``docs`` (id, content), of unit length."""
    from tessera.functions.text import tokens
    from tessera.functions.vectors import hash_bucket

    tf = docs.select("id", F.explode(tokens(F.col("content"))).alias("term")).groupBy("id", hash_bucket(F.col("term"), dimension).alias("bucket")).agg(F.count("*").alias("tf"))
    length = Window.partitionBy("id")
    return tf.withColumn("weight", F.col("tf") / F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(length).cast("double"))).select("id", "bucket", "weight")


def sparse_top(embedded: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(id, score): inner product of sparse vectors with a sparse query (bucket, weight)."""
    q = query.select("bucket", F.col("weight").alias("q"))
    scored = embedded.join(F.broadcast(q), "bucket").groupBy("id").agg(F.round(F.sum(F.col("weight") * F.col("q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


__all__ = ["batch_top", "guarded", "hash_embedding", "lsh_buckets", "lsh_candidates", "lsh_model", "lsh_signatures", "lsh_top", "near_buckets", "norm", "query_vector", "scores", "signature_rows", "sparse_top", "top"]
