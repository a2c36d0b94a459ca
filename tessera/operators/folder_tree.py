"""Merkle tree of folders: inner nodes by folder, and a comparison that descends only where they differ.

A folder's children are dealt to fans by the first digits of their names' hashes; a
fan's hash is taken over its children, a folder's over its fans.  So no task sees a
whole folder, however many files it has, and one changed file leads to one fan of it.

The tree is written level by level, the deepest first, as one Parquet table by
level: a row for each folder's fan (``kind`` fan), and for each child under its fan
(file, folder).  A comparison starts at the roots, reads of every level only what lies
below unlike nodes, and writes what it met.

States are (relative_path, hash).  Of rows of one path the smallest hash counts,
rows without a path are left out, a null hash counts as an empty one; an empty
state has a root without fans.  ``a`` may be a file and a folder at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.places import fresh_folder

WIDTH = 3
#: Up to so many unlike parents are named in the scan's filter; beyond, the join alone selects.
NAMED = 1000
LEVEL_TYPE = "parent string, node string, kind string, hash string"


def _sha(column: Column) -> Column:
    return F.sha2(column, 256)


def _over(parts: Column) -> Column:
    """Hash over a group's strings in order."""
    return _sha(F.array_join(F.sort_array(F.collect_list(parts)), ""))


class FolderTree:
    """A written tree: ``at`` the folder of its levels, ``depth`` their number, ``root`` the root's hash."""

    def __init__(self, spark: SparkSession, at: str, depth: int, root: str):
        self.spark, self.at, self.depth, self.root = spark, at, depth, root

    def level(self, number: int) -> DataFrame:
        """(parent, node, kind, hash) of fans below folders of that depth, and of what lies below those fans."""
        if number >= self.depth:
            return self.spark.createDataFrame([], LEVEL_TYPE)
        return self.spark.read.schema(LEVEL_TYPE).parquet(f"{self.at}/level={number}")

    def nodes(self) -> DataFrame:
        """(node, kind, hash): folders and files; the root is the folder of empty name."""
        found = self.spark.createDataFrame([("", "folder", self.root)], "node string, kind string, hash string")
        for number in range(self.depth):
            found = found.unionByName(self.level(number).filter("kind <> 'fan'").select("node", "kind", "hash"))
        return found


def build(spark: SparkSession, state: DataFrame, width: int = WIDTH) -> FolderTree:
    """Hash and write the levels of a state; each is one aggregation by fan and one by folder."""
    at = fresh_folder(spark, "folders")
    parts = F.split("relative_path", "/")
    files = state.filter("relative_path IS NOT NULL").groupBy("relative_path").agg(F.coalesce(F.min("hash"), F.lit("")).alias("hash"))
    files = files.select((F.size(parts) - 1).alias("level"), F.col("relative_path").alias("node"), F.lit("file").alias("kind"), "hash")
    files.repartition("level", F.pmod(F.xxhash64("node"), F.lit(spark.sparkContext.defaultParallelism))).write.partitionBy("level").parquet(f"{at}/files")
    files = spark.read.schema("node string, kind string, hash string, level int").parquet(f"{at}/files")
    deepest = files.agg(F.max("level")).first()[0]
    if deepest is None:
        return FolderTree(spark, at, 0, _of_nothing(spark))
    folders = None
    for number in range(deepest, -1, -1):
        below = files.filter(F.col("level") == number).select("node", "kind", "hash")
        below = below if folders is None else below.unionByName(folders)
        name = F.substring_index("node", "/", -1)
        folder = F.when(F.instr("node", "/") > 0, F.expr("substr(node, 1, length(node) - length(substring_index(node, '/', -1)) - 1)")).otherwise("")
        children = below.select(F.concat(folder, F.lit("//"), F.substring(_sha(name), 1, width)).alias("parent"), "node", "kind", "hash", _sha(name).alias("name"))
        fans = children.groupBy(F.col("parent").alias("node")).agg(_over(F.concat(F.substring("kind", 1, 2), "name", "hash")).alias("hash"))
        fans = fans.select(F.expr("substr(node, 1, length(node) - %d)" % (width + 2)).alias("parent"), "node", F.lit("fan").alias("kind"), "hash")
        level = children.drop("name").unionByName(fans)
        level.repartitionByRange("parent").sortWithinPartitions("parent", "node").write.parquet(f"{at}/level={number}")
        fans = spark.read.schema(LEVEL_TYPE).parquet(f"{at}/level={number}").filter("kind = 'fan'")
        folders = fans.groupBy(F.col("parent").alias("node")).agg(_over(F.concat(F.right("node", F.lit(width)), "hash")).alias("hash"))
        folders = folders.select("node", F.lit("folder").alias("kind"), "hash")
    return FolderTree(spark, at, deepest + 1, folders.first()["hash"])


def _of_nothing(spark: SparkSession) -> str:
    return spark.range(1).select(_sha(F.lit(""))).first()[0]


def _met(old: DataFrame, new: DataFrame, unlike: DataFrame) -> DataFrame:
    """(node, kind, old, new): what lies below the unlike parents on either side."""
    named = [r["node"] for r in unlike.limit(NAMED + 1).collect()]

    def below(side: DataFrame, hash_name: str) -> DataFrame:
        if len(named) <= NAMED:
            side = side.filter(F.col("parent").isin(named))
        return side.join(unlike.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "kind", F.col("hash").alias(hash_name))

    return below(old, "old").join(below(new, "new"), ["node", "kind"], "full_outer")


def compare(old: FolderTree, new: FolderTree) -> tuple[DataFrame, int]:
    """((relative_path, change), nodes met): files added, removed or modified, and how many nodes were compared."""
    spark, at = old.spark, fresh_folder(old.spark, "compared")
    kind = "node string, kind string, old string, new string"
    none, met = spark.createDataFrame([], kind), 1
    unlike = spark.createDataFrame([("", "folder", old.root, new.root)], kind).filter("old <> new")
    changed = none
    for number in range(max(old.depth, new.depth)):
        if unlike.isEmpty():
            break
        sides = old.level(number), new.level(number)
        for step in ("fans", "children"):  # unlike folders' fans, then unlike fans' children
            _met(*sides, unlike).write.parquet(f"{at}/{number}-{step}")
            written = spark.read.schema(kind).parquet(f"{at}/{number}-{step}")
            met += written.count()
            unlike = written.filter("NOT (old <=> new)")
        changed = changed.unionByName(unlike.filter("kind = 'file'"))
        unlike = unlike.filter("kind = 'folder'")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return changed.select(F.col("node").alias("relative_path"), change.alias("change")), met
