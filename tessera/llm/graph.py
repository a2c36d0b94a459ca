"""Connected components of a graph too large for one machine.

Alternating large-star and small-star steps (MapReduce connected components,
Kiveris et al., 2014) on an edge table; every step is written to the shared
folder, so lineage stays short and nothing is collected but two numbers.  Hubs
are no hot keys: minima are combined before they are shuffled, and the joins are
ones whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize

FILE_ROWS = 1_000_000


def _mark(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("s")).first()
    return got["n"], got["s"] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the component's smallest node.

    Repeated edges, loops and nulls are allowed; a node with loops only, or a
    null end, has no row.  The order of rows and of ends doesn't matter, so there are
    no ties to break.  An empty table gives an empty result; other columns are not
    looked at.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("w"))
        hooked = large.join(smallest, "u").filter("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        found = hooked.unionByName(smallest.withColumnRenamed("w", "v")).distinct()
        passed, now = now, materialize(found.coalesce(-(-2 * mark[0] // FILE_ROWS)), "edges")
        before, mark = mark, _mark(now)
        discard(passed)
        if mark == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
