"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Everything is DataFrame and SQL functions.  Each text becomes base counts (words,
their characters, symbols, duplicate lines, words in repeated 3-word windows) and
from them a vector of transformed statistics.  Per language and source, the mean
and covariance of the most central ``SUBSET`` share of the vectors is estimated
by concentration steps: from a start, measure squared Mahalanobis distances, keep
the closest share, re-estimate, repeat.  There are three starts: medians with
squared interquartile ranges, medians with the floors below, and the mean and
covariance of all.  Of their ends the one with the smallest determinant counts
(of equals the first).  A document is rejected if its distance to its group's
estimate exceeds ``CUTOFF``.

How it scales: the counts are written once, and so are the vectors by group;
every later pass reads a few numbers a document.  All starts take their steps in
the same passes.  Means and covariances are sums, combined before the shuffle.
The cut that keeps the closest share comes from counts on a fixed fine grid of
log-distances, so no group's values are ever collected or sorted: what moves is
at most the grid's cells for each group, added up by cell first.  Estimates and
cuts are written tables of a row or three a group, so rows meet them without
being dealt out by group, unless there are too many groups to broadcast.  Groups of under ``LEAST`` usable rows
take their language's estimate, and languages of under ``LEAST`` the corpus's.

Variances get a floor (``FLOORS``, squared): where more than half of a group has
exactly zero symbols, say, the estimate would be singular.

Vectors are whole multiples of 1/4096, so their sums are exact whatever the
order of addition.

Defined results: a null or empty text has zero words and fails the base rules;
a text of any length counts whole; null languages and sources are groups like any other; documents that fail the
base rules take no part in the estimates and are not kept; equal texts of a
group fare equally; an empty table gives an empty result; other columns pass
through inside ``doc``, the text left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

STATS = ("log_words", "word_chars_mean", "symbols_log", "dup_lines_share", "repeats_share")
FLOORS = (0.5, 0.25, 0.25, 0.1, 0.1)
SUBSET = 0.75
STEPS = 3
LEAST = 50
#: Squared distance above which a document goes: the 0.99999 quantile of chi-squared with 5 degrees of freedom, tripled for the heavy tails of text statistics.
CUTOFF = 3 * 30.86
#: Fixed value: the median of chi-squared with 5 degrees of freedom.
CHI2_MEDIAN = 4.351
SCALE = 4096.0
GRID = 64.0
SPACE = r"[\x20\x09-\x0D]+"


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words): ``doc`` is the row as a struct."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # one expression per step, so that none is evaluated twice
    split = row.select("doc", "t", F.filter(F.split("t", SPACE), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counted = split.select(
        "doc",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    kept = ["doc", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    hashed = counted.select(*kept, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    # windows as (their three word hashes, position); slices of one array, zipped
    n = F.col("n_words").cast("int")
    tail = lambda k: F.slice("h", k, F.greatest(n - 2, F.lit(0)))
    zipped = hashed.select(*kept, F.arrays_zip(tail(1).alias("a"), tail(2).alias("b"), tail(3).alias("c")).alias("z"))
    windows = zipped.select(*kept, F.sort_array(F.transform("z", lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["c"].alias("c"), i.alias("i")))).alias("s"))
    m = F.size("s")
    beside = windows.select(*kept, F.arrays_zip(F.col("s"), F.slice("s", 2, F.greatest(m - 1, F.lit(0))).alias("q")).alias("p"))
    same = lambda x: (x["s"]["a"] == x["q"]["a"]) & (x["s"]["b"] == x["q"]["b"]) & (x["s"]["c"] == x["q"]["c"])
    twins = beside.select(*kept, F.flatten(F.transform(F.filter("p", same), lambda x: F.array(x["s"]["i"], x["q"]["i"]))).alias("d"))
    starts = twins.select(*kept, F.sort_array(F.array_distinct("d")).alias("d"))
    gaps = starts.select(*kept, "d", F.zip_with("d", F.slice("d", 2, F.greatest(F.size("d") - 1, F.lit(0))), lambda x, y: F.least(F.coalesce(y - x, F.lit(3)), F.lit(3))).alias("g"))
    covered = F.aggregate("g", F.lit(0).cast("long"), lambda total, x: total + x)
    return gaps.select(*kept, covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def _statistics() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_dup_lines") + n / 20, F.lit(1.0))
    raw = [F.log(n), F.col("word_chars") / n, F.log(F.lit(0.01) + F.col("n_symbols") / n), lines, F.sqrt(F.col("n_repeat_words") / n)]
    return [F.round(x * SCALE) / SCALE for x in raw]


def _x(k: int) -> str:
    return f"x{k}"


P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
KEYS = ["grp", "start"]


def _with_distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance of x by the centre m and the Cholesky factor l (forward substitution)."""
    for i in range(P):
        rest = reduce(lambda a, b: a - b, [F.col(f"l{i}{j}") * F.col(f"z{j}") for j in range(i)], F.col(_x(i)) - F.col(f"m{i}"))
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)]))


def _cholesky(estimates: DataFrame) -> DataFrame:
    """(grp, start, m*, l*) from (grp, start, m*, c*): the factor of the covariance, row by row."""
    for i, j in sorted(PAIRS):
        inner = reduce(lambda a, b: a - b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.col(f"c{i}{j}"))
        value = F.sqrt(F.greatest(inner, F.lit(1e-9))) if i == j else inner / F.col(f"l{j}{j}")
        estimates = estimates.withColumn(f"l{i}{j}", value)
    return estimates.select(*KEYS, *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS])


def _grid_quantile(cells: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, cell): the first cell up to which ``share`` of a group's counts lie; ``cells`` has keys, cell, n."""
    upto = Window.partitionBy(*keys).orderBy("cell")
    whole = Window.partitionBy(*keys)
    marked = cells.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole))
    return marked.filter(F.col("upto") >= F.col("all") * share).groupBy(*keys).agg(F.min("cell").alias("cell"))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m*, c*) of the rows of each group; variances get their floor."""
    sums = [F.avg(_x(i)).alias(f"m{i}") for i in range(P)] + [F.avg(F.col(_x(i)) * F.col(_x(j))).alias(f"s{i}{j}") for i, j in PAIRS]
    got = rows.groupBy(*keys).agg(*sums)
    cov = [(F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + F.lit(FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    return got.select(*keys, *[f"m{i}" for i in range(P)], *cov)


def _starts(rows: DataFrame) -> DataFrame:
    """(grp, start, m*, c*), three rows a group: medians with squared interquartile ranges, medians with the floors, and the moments of all."""
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.floor(F.col(_x(i)) * GRID).alias("cell")) for i in range(P)]))
    cells = rows.select("grp", stacked.alias("e")).groupBy("grp", "e.k", "e.cell").agg(F.count("*").alias("n")).toDF("grp", "k", "cell", "n")
    cells = materialize(cells, "cells")
    parts = [_grid_quantile(cells, ["grp", "k"], q).withColumnRenamed("cell", name) for q, name in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
    joined = parts[1].join(parts[0], ["grp", "k"]).join(parts[2], ["grp", "k"])
    wide = [F.max(F.when(F.col("k") == i, (F.col("q2") + 0.5) / GRID)).alias(f"m{i}") for i in range(P)]
    wide += [F.max(F.when(F.col("k") == i, F.pow((F.col("q3") - F.col("q1")) / (GRID * 1.349), F.lit(2.0)) + FLOORS[i] ** 2)).alias(f"c{i}{i}") for i in range(P)]
    middle = joined.groupBy("grp").agg(*wide).withColumns({f"c{i}{j}": F.lit(0.0) for i, j in PAIRS if i != j})
    round_one = middle.withColumns({f"c{i}{i}": F.lit(FLOORS[i] ** 2) for i in range(P)})
    listed = [middle, round_one, _moments(rows, ["grp"])]
    return reduce(DataFrame.unionByName, [df.withColumn("start", F.lit(k)) for k, df in enumerate(listed)])


def _cells(measured: DataFrame, keys: list[str]) -> DataFrame:
    cell = F.floor(F.log(F.col("d2") + 1e-9) * GRID)
    return measured.groupBy(*keys, cell.alias("cell")).agg(F.count("*").alias("n"))


def estimates(rows: DataFrame) -> DataFrame:
    """(grp, m*, l*, scale): the minimum covariance determinant estimate of each group of ``rows`` (grp, x*)."""
    now = materialize(_cholesky(_starts(rows)), "start")
    for _ in range(STEPS):
        measured = _with_distance(rows.join(now, "grp"))
        cut = materialize(_grid_quantile(_cells(measured, KEYS), KEYS, SUBSET), "cut")
        close = measured.select(*KEYS, *[_x(i) for i in range(P)], F.floor(F.log(F.col("d2") + 1e-9) * GRID).alias("at")).join(cut, KEYS).filter("at <= cell")
        now = materialize(_cholesky(_moments(close, KEYS)), "step")
    determinant = reduce(lambda a, b: a * b, [F.col(f"l{i}{i}") * F.col(f"l{i}{i}") for i in range(P)])
    best = now.groupBy("grp").agg(F.min(F.struct(determinant.alias("det"), "start", *now.columns[2:])).alias("e")).select("grp", *[f"e.{c}" for c in now.columns[2:]])
    best = materialize(best, "best")
    middle = _grid_quantile(_cells(_with_distance(rows.join(best, "grp")), ["grp"]), ["grp"], 0.5)
    # consistency: the median distance should be chi-squared's; a scale below one would only tighten it
    scale = F.greatest(F.exp((F.col("cell") + 0.5) / GRID) / CHI2_MEDIAN, F.lit(1.0))
    return best.join(middle, "grp").withColumn("scale", scale).drop("cell")


def judge(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc, base counts, base_failed, distance, kept) for every row; distance is null where the base rules fail."""
    counted = base_counts(docs, text_col).withColumn("base_failed", base_failed())
    names = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    lang, source = (F.col(f"doc.`{c}`").cast("string") for c in (lang_col, source_col))
    counted = counted.withColumns({_x(i): c for i, c in enumerate(_statistics())})
    counted = counted.withColumns({"g2": names(lang.alias("l"), source.alias("s")), "g1": names(lang.alias("l")), "g0": F.lit("{}")})
    light = materialize(counted.select(F.col("doc").dropFields(text_col) if len(docs.columns) > 1 else F.lit(None).alias("doc"), *counted.columns[1:]).toDF(*counted.columns), "counts")
    usable = light.filter("NOT base_failed")
    named = usable.groupBy("g2", "g1").agg(F.count("*").alias("n2"))
    named = named.withColumn("n1", F.sum("n2").over(Window.partitionBy("g1")))
    choice = named.select("g2", F.when(F.col("n2") >= least, F.col("g2")).when(F.col("n1") >= least, F.col("g1")).otherwise(F.lit("{}")).alias("use"))
    choice = materialize(choice, "groups")
    xs = [_x(i) for i in range(P)]
    # every row counts for its own group, its language and the corpus; only the estimates in use are made
    levels = F.explode(F.array("g2", "g1", "g0"))
    used = choice.select(F.col("use").alias("grp")).distinct()
    rows = materialize(usable.select(levels.alias("grp"), *xs).join(used, "grp", "left_semi"), "vectors")
    est = materialize(estimates(rows), "estimates")
    judged = _with_distance(light.join(choice, "g2", "left").join(est.withColumnRenamed("grp", "use"), "use", "left"))
    distance = F.when(~F.col("base_failed"), F.col("d2") / F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2") / F.col("scale"), F.lit(0.0)) <= CUTOFF)
    return judged.select("doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"), kept.alias("kept"))
