"""Reciprocal rank fusion of two rankings, lookup of what they name, and result texts."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import file_extension
from tessera.messages import RESULT, TRUNCATED



def ranked(leg: DataFrame, per: str | None = None) -> DataFrame:
    """``leg`` (id, score) with its 1-based rank r, ties by id; ``leg`` holds a few rows per query."""
    order = (Window.partitionBy(per) if per else Window).orderBy(F.desc("score"), "id")
    return leg.withColumn("r", F.row_number().over(order).cast("long"))


def fuse(legs: list[DataFrame], k: int = 100, per: str | None = None) -> DataFrame:
    """(id, score, legs): sums of 1 / (k + rank) over the legs; each leg is already cut to its candidates."""
    keys = [per] if per else []
    every = None
    for leg in legs:
        own = ranked(leg, per).select(*keys, "id", (F.lit(1.0) / (F.lit(k) + F.col("r"))).alias("part"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy(*keys, "id").agg(F.round(F.sum("part"), 9).alias("score"), F.count("*").alias("legs"))


def fused_top(fused: DataFrame, limit: int) -> DataFrame:
    return fused.orderBy(F.desc("score"), "id").limit(limit)


def with_rank(fused: DataFrame, candidates: int = 100) -> DataFrame:
    """Fused rows with their place; the rows of both legs bound how many there are."""
    order = Window.orderBy(F.desc("score"), "id")
    return fused.orderBy(F.desc("score"), "id").limit(candidates).withColumn("rank", F.row_number().over(order).cast("long"))


def lookup(placed: DataFrame, chunks: DataFrame, extensions=None, limit: int = 10, least: float | None = None) -> DataFrame:
    """Results: ranks are given before the lookup, missing ids drop out and leave gaps, filters come before the limit.

    ``placed`` is at most two legs' candidates, so it is the side that is broadcast.
    """
    found = chunks.join(F.broadcast(placed), "id")
    if extensions:
        found = found.filter(file_extension(F.col("file_path")).isin(list(extensions)))
    if least is not None:
        found = found.filter(F.col("score") >= least)
    return found.orderBy("rank").limit(limit)


def snippet(content: Column, most: int = 5000) -> Column:
    """At most ``most`` bytes of a text, cut back to a whole character, and a mark where it was cut."""
    raw = content.cast("binary")
    # the cut is inside a character where the next byte is a continuation byte (10xxxxxx); at most three bytes back
    byte = lambda at: F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int")
    inside = lambda n: F.floor(byte(most - n + 1) / 64) == 2
    cut = F.when(~inside(0), most).when(~inside(1), most - 1).when(~inside(2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(content) <= most, content).otherwise(F.concat(F.substr(raw, F.lit(1), cut).cast("string"), F.lit(TRUNCATED)))


def result_text(results: DataFrame, codebase: str, snippet_bytes: int = 5000) -> DataFrame:
    """(rank, display_rank, text): how each of a few results is shown."""
    order = Window.orderBy("rank")
    shown = results.withColumn("display_rank", F.row_number().over(order).cast("long"))
    location = F.concat("relative_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    values = {
        "index": F.col("display_rank").cast("string"), "language": F.col("language"), "codebase": F.lit(codebase), "location": location,
        "snippet": snippet(F.col("content"), snippet_bytes),
    }
    parts = [part for literal, name, *_ in Formatter().parse(RESULT) for part in ([F.lit(literal)] if literal else []) + ([values[name]] if name else [])]
    text = F.concat(*parts)
    return shown.select("rank", "display_rank", text.alias("text"))
