"""Approximate nearest neighbours by a proximity graph, for many queries at once.

The graph is a table (id, nb, sim): each vector's ``DEGREE`` nearest known ones by
cosine and those that have it among theirs.  It starts from groups of vectors on the
same sides of random hyperplanes, in which all are compared, and is bettered by
rounds in which the neighbours of each vector, at most twice ``DEGREE``, meet in one
row and are compared with each other.  So vectors travel to where they are compared,
as they were given, and pairs don't carry them: a comparison hands on two ids and a
similarity, and only if it betters what is known.

A search starts every query at its best of ``PIVOTS`` vectors and keeps its ``WIDTH``
best so far.  In each round the ``STEP`` best that were not followed yet are, for all
queries in one join with the graph; what was scored before is left out, the rest is
scored and cut to the best again, until every query has followed all it keeps.
Rounds are written tables, so that neither plans nor lost executors add up.

Vectors that are null, empty, zero or not finite are in no graph and no result; a
query like that finds nothing.  Ids are distinct.  Equal vectors are neighbours of
each other in any order; groups of more than ``LEAF`` are divided by hash, so none is
compared in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.batches import small_batches
from tessera.functions.vectors import as_double, dot, norm
from tessera.sources.places import fresh_folder

DEGREE, ROUNDS = 16, 2
LEAF, TREES = 2048, 8
#: Rows of a product of matrices; meetings that are computed at once.
BLOCK, MEETINGS = 512, 256
WIDTH, STEP, PIVOTS = 96, 16, 64


def unit(vectors: DataFrame) -> DataFrame:
    """(id, v, given): vectors of length one, and as they were; those without a direction are left out."""
    v = vectors.select("id", F.col("vector").alias("given"), as_double(F.col("vector")).alias("v")).withColumn("n", norm(F.col("v")))
    sound = v.filter((F.col("n") > 0) & (F.col("n") < float("inf")) & ~F.isnan("n"))
    return sound.select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"), "given")


def _kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _best(edges: DataFrame, by: str, n: int) -> DataFrame:
    """The n rows of largest ``sim`` of each ``by``."""
    other = "nb" if by == "id" else "id"
    order = Window.partitionBy(by).orderBy(F.desc("sim"), other)
    return edges.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("place")


def _matrix(vectors: pa.ListArray, rows: int) -> np.ndarray:
    """Vectors of one length, as given, as rows of length one."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _within(degree: int):
    def compared(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        x = _matrix(table.column("given").combine_chunks(), len(ids))
        most = min(degree, len(ids) - 1)
        rows, near, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for a in range(0, len(ids) if most else 0, BLOCK):
            s = x[a : a + BLOCK] @ x.T
            own = np.arange(len(s))
            s[own, a + own] = -np.inf
            at = np.argpartition(-s, most - 1, axis=1)[:, :most]
            rows.append(np.repeat(a + own, most))
            near.append(at.ravel())
            sims.append(np.take_along_axis(s, at, 1).ravel())
        rows, near, sims = (np.concatenate(x) for x in (rows, near, sims))
        return pa.table({"id": ids.take(pa.array(rows)), "nb": ids.take(pa.array(near)), "sim": sims})

    return compared


def _first_edges(units: DataFrame, n: int, dimension: int, degree: int, leaf: int, trees: int) -> DataFrame:
    """Edges among vectors that share the sides of a tree's hyperplanes."""
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    rng = np.random.default_rng(29)
    kind = units.schema["id"].dataType.simpleString()
    # of vectors that fit one group every tree would compare the same pairs
    planes = [[F.array(*[F.lit(float(x)) for x in rng.standard_normal(dimension)]) for _ in range(bits)] for _ in range(trees if bits else 1)]
    sides = lambda tree: F.concat_ws("", *[(dot(F.col("v"), p) >= 0).cast("int").cast("string") for p in tree])
    coded = units.select("id", "given", F.explode(F.array(*[F.concat(F.lit(f"{k}:"), sides(tree)) for k, tree in enumerate(planes)])).alias("code"))
    # a code of too many vectors is divided by hash; codes are few
    sizes = coded.groupBy("code").agg(F.ceil(F.count("*") / (2 * leaf)).alias("shards"))
    dealt = coded.join(F.broadcast(sizes), "code").withColumn("shard", F.pmod(F.xxhash64("id", "code"), F.col("shards")))
    found = dealt.groupBy("code", "shard").applyInArrow(_within(degree), f"id {kind}, nb {kind}, sim double")
    return _best(found.dropDuplicates(["id", "nb"]), "id", degree)


def _met(degree: int):
    """For every row of members (id, bar, given) that meet: each member's best others, those of a similarity above its bar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, MEETINGS):
                held = whole.column("members").slice(first, MEETINGS)
                ids, bars, given = held.flatten().flatten()
                x, bars = _matrix(given, len(ids)), bars.to_numpy(zero_copy_only=False)
                sizes = held.value_lengths().to_numpy()
                starts, most = np.cumsum(sizes) - sizes, int(sizes.max())
                # rows of one width; what fills them up is no candidate
                at = np.minimum(starts[:, None] + np.arange(most), len(x) - 1)
                real = np.arange(most) < sizes[:, None]
                s = x[at] @ x[at].transpose(0, 2, 1)
                s[~(real[:, :, None] & real[:, None, :])] = -np.inf
                s[:, np.arange(most), np.arange(most)] = -np.inf
                if most > degree:
                    s[s < -np.partition(-s, degree - 1, axis=2)[:, :, degree - 1 : degree]] = -np.inf
                row, one, other = np.nonzero(s > bars[at][:, :, None])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[row, one])), ids.take(pa.array(at[row, other])), pa.array(s[row, one, other])], names=["id", "nb", "sim"])

    return run


def _bettered(edges: DataFrame, units: DataFrame, degree: int) -> DataFrame:
    """``edges`` after the neighbours of each vector, and those that have it among theirs, have met."""
    kind = units.schema["id"].dataType.simpleString()
    bars = edges.groupBy("id").agg(F.count("*").alias("n"), F.min("sim").alias("bar")).select("id", F.when(F.col("n") == degree, F.col("bar")).otherwise(-2.0).alias("bar"))
    both = edges.select("id", "nb").unionByName(_best(edges, "nb", degree).select(F.col("nb").alias("id"), F.col("id").alias("nb"))).distinct()
    # a vector meets its neighbours, too: an edge has two ends
    at = both.select(F.col("id").alias("place"), F.col("nb").alias("id")).unionByName(units.select(F.col("id").alias("place"), "id"))
    held = units.select("id", "given").join(bars, "id", "left").select("id", "given", F.coalesce("bar", F.lit(-2.0)).alias("bar"))
    met = at.join(held, "id").groupBy("place").agg(F.collect_list(F.struct("id", "bar", "given")).alias("members"))
    new = met.select("members").mapInArrow(_met(degree), f"id {kind}, nb {kind}, sim double")
    return _best(edges.unionByName(new).groupBy("id", "nb").agg(F.max("sim").alias("sim")), "id", degree)


def build(vectors: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, leaf: int = LEAF, trees: int = TREES, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(graph, unit vectors) of ``vectors`` (id, vector), as tables in ``folder``."""
    spark = vectors.sparkSession
    small_batches(spark)
    folder = folder or fresh_folder(spark, "graph")
    units = _kept(unit(vectors), folder, "units")
    n, dimension = units.agg(F.count("*"), F.max(F.size("v"))).first()
    edges = _kept(_first_edges(units, n, dimension or 1, degree, leaf, trees), folder, "edges-0")
    for k in range(rounds if n > leaf else 0):  # in one group all were compared
        edges = _kept(_bettered(edges, units, degree), folder, f"edges-{k + 1}")
    units = units.select("id", "v")
    back = _best(edges, "nb", 2 * degree).select(F.col("nb").alias("id"), F.col("id").alias("nb"), "sim")
    return _kept(edges.unionByName(back).dropDuplicates(["id", "nb"]), folder, "graph"), units


@dataclass
class Found:
    """``top``: (query_id, id, score, rank); ``scored``: (query_id, id, sim), every comparison that was made."""

    top: DataFrame
    scored: DataFrame
    rounds: int


def search(graph: DataFrame, units: DataFrame, queries: DataFrame, k: int, width: int = WIDTH, step: int = STEP, pivots: int = PIVOTS, folder: str | None = None) -> Found:
    """The k nearest vectors by cosine for every row of ``queries`` (query_id, query)."""
    spark = graph.sparkSession
    folder = folder or fresh_folder(spark, "search")
    asked = _kept(unit(queries.select(F.col("query_id").alias("id"), F.col("query").alias("vector"))).select(F.col("id").alias("query_id"), F.col("v").alias("q")), folder, "queries")
    starts = units.orderBy(F.xxhash64("id"), "id").limit(pivots)
    similar = lambda pairs: pairs.select("query_id", "id", dot(F.col("v"), F.col("q")).alias("sim"))
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    ranked = lambda df, n: df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    write = lambda df, at: df.write.mode("overwrite").parquet(f"{folder}/scored/round={at}")
    write(similar(asked.crossJoin(F.broadcast(starts))), 0)  # a fixed number of pivots
    every = lambda: spark.read.schema("query_id " + kinds[0] + ", id " + kinds[1] + ", sim double").parquet(f"{folder}/scored")
    kinds = [asked.schema["query_id"].dataType.simpleString(), units.schema["id"].dataType.simpleString()]
    pool, at = _kept(ranked(every(), width).select("query_id", "id", "sim", F.lit(False).alias("followed")), folder, "pool-0"), 0
    while not pool.filter("NOT followed").isEmpty():
        at += 1
        front = ranked(pool.filter("NOT followed"), step).select("query_id", "id")
        near = front.join(graph.select("id", "nb"), "id").select("query_id", F.col("nb").alias("id")).distinct()
        new = near.join(every().select("query_id", "id"), ["query_id", "id"], "left_anti")
        write(similar(new.join(units, "id").join(asked, "query_id")), at)
        fresh = spark.read.parquet(f"{folder}/scored/round={at}").withColumn("followed", F.lit(False))
        held = pool.join(front.withColumn("now", F.lit(True)), ["query_id", "id"], "left").select("query_id", "id", "sim", (F.col("followed") | F.coalesce("now", F.lit(False))).alias("followed"))
        pool = _kept(ranked(held.unionByName(fresh.select(held.columns)), width).drop("place"), folder, f"pool-{at}")
    top = pool.select("query_id", "id", F.round("sim", 6).alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = top.withColumn("rank", F.row_number().over(by_score).cast("long")).filter(F.col("rank") <= k)
    return Found(top, every(), at)
