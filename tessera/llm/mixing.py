"""Mixing sources to target weights, with DataFrame functions only.

Targets: the total number of words is shared by weight among the sources, a
source's target stops at ``max_rate`` times its own size, and what is cut off is
shared again by weight among the others.  That is water-filling.  Its level is
found in one pass over the sources in the order of the level at which each one
overflows: were all before it full, the rest shared by weight would give a
level; that of the first source that does not overflow, which is the largest of
those that fit, is the answer.  One task orders the sources, a row of some 100
bytes each, so a few million of them are no burden; documents are never ordered.

Copies: a source's rate is target / size; each document is emitted floor(rate)
times, plus once more if its hash, a uniform number in [0, 1), is below the
fraction.  The hash comes from the document id and text; ``rotations`` shifted
versions of it are all valid seeds, and each source takes the one whose total
lies nearest its target, so that small sources come near it too.

Defined results: a null text has size 0; documents of size 0 take 0 words and
are emitted by the same rule as others; a null source is a source of its own
and sorts last; equal rows have equal hashes, hence equal copies; an empty
table gives an empty result; a text of any length counts with all its words;
other columns pass through untouched, whatever their names (they travel inside
one struct).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialize

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
ROTATIONS = 32
_UNIT = 2**32
_STEP = _UNIT // ROTATIONS


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(doc_id: Column, text: Column) -> Column:
    """A uniform integer below 2**32 for a document."""
    key = F.concat_ws(":", doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    ``sized`` has the columns source and size.  Everything after the first
    aggregation runs on one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("overflow", F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size").cast("double") * max_rate)
        .withColumn("overflow", F.col("cap") / F.col("weight"))
    )
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    leveled = (
        listed.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("fits", F.when(F.col("level") <= F.col("overflow"), F.col("level")))
        .withColumn("final", F.max("fits").over(whole))
    )
    return leveled.select("source", "source_size", "weight", F.least("cap", F.col("final") * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc, source, size, hashed) of every row."""
    text, row = F.col(f"`{text_col}`"), F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("doc"), F.col(f"`{source_col}`").alias("source"), n_words(text).alias("size"), _hash(F.col(f"`{id_col}`"), text).alias("hashed"))


def decisions(sized: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """One row per source: s, source_size, target, whole (copies of every document), edge and turn (see ``_copies``).

    A seed turns the hash by k steps of ``_STEP``.  Whether a turned hash lies below
    the fraction is known from the step its hash lies in, but for the one step
    that the fraction cuts; so sizes are summed by source and step, below the
    cut and in all, and all seeds are compared on those few sums.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = source_targets(sized, weights, max_rate).withColumn("rate", rate)
    targets = targets.select(F.col("source").alias("s"), "source_size", "target", F.floor("rate").alias("whole"), ((F.col("rate") - F.floor("rate")) * float(_UNIT)).alias("edge"))
    # tables of one row per source are written, so their size is known and decides how they are joined
    targets = materialize(targets, "targets")
    step, low = (F.col("hashed") / _STEP).cast("int"), F.col("hashed") % _STEP
    cut = F.floor(F.col("edge") / _STEP)
    joined = sized.select("source", "size", step.alias("step"), low.alias("low")).join(targets, F.col("source").eqNullSafe(F.col("s")))
    below = F.when(F.col("low") < F.col("edge") - cut * _STEP, F.col("size")).otherwise(0)
    keys = ["s", "source_size", "target", "whole", "edge"]
    steps = joined.groupBy(*keys, "step").agg(F.sum("size").alias("all"), F.sum(below).alias("below"))
    listed = steps.groupBy(*keys).agg(F.collect_list(F.struct("step", "all", "below")).alias("steps"))  # ROTATIONS at most

    def off(turn: Column) -> Column:
        place = lambda x: (x["step"] + turn) % ROTATIONS
        extra = lambda x: F.when(place(x) < cut, x["all"]).when(place(x) == cut, x["below"]).otherwise(F.lit(0).cast("long"))
        got = F.aggregate("steps", F.lit(0).cast("long"), lambda total, x: total + F.col("whole") * x["all"] + extra(x))
        return F.abs(got - F.col("target"))

    turns = F.transform(F.sequence(F.lit(0), F.lit(ROTATIONS - 1)), lambda k: F.struct(off(k).alias("off"), k.alias("turn")))
    return materialize(listed.select(*keys, F.array_min(turns)["turn"].alias("turn")), "rotations")


def _copies() -> Column:
    turned = (F.col("hashed") + F.col("turn").cast("long") * F.lit(_STEP)) % F.lit(_UNIT)
    return (F.col("whole") + (turned < F.col("edge")).cast("long")).cast("long")


def _decided(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    return rows.join(chosen, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", _copies())


def mix_sizes(
    docs: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(doc_id, size, source_size, target, copies): texts are read once, and numbers only in the passes after."""
    sized = _sized(docs, id_col, text_col, source_col).select(F.col(f"doc.`{id_col}`").alias("doc_id"), "source", "size", "hashed")
    sized = materialize(sized, "sizes")
    return _decided(sized, decisions(sized, weights, max_rate)).select("doc_id", "size", "source_size", "target", "copies")


def mix_plan(
    docs: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``docs`` with its decisions: doc (struct of the row), size, source_size, target, copies.

    Texts are read twice: once for the sources' sums, once for the result.
    """
    rows = _sized(docs, id_col, text_col, source_col)
    chosen = decisions(materialize(rows.drop("doc"), "sizes"), weights, max_rate)
    return _decided(rows, chosen).select("doc", "size", "source_size", "target", "copies")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as its copies say, with the columns of ``docs``."""
    planned = mix_plan(docs, **options).filter("copies > 0")
    return planned.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
