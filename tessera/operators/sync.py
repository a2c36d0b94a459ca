"""What changed between two states of a codebase: hashes, Merkle nodes, differences, and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_hashes(files: DataFrame) -> DataFrame:
    """(relative_path, hash) of ``files`` (relative_path, and content or a hash that was taken when they were read)."""
    if "hash" in files.columns:
        return files.select("relative_path", "hash")
    return files.select("relative_path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


def merkle_leaves(hashes: DataFrame) -> DataFrame:
    """(node, data): a leaf per file, named by the hash of its data."""
    data = F.concat_ws(":", "relative_path", "hash")
    return hashes.select(F.sha2(data, 256).alias("node"), data.alias("data"))


def merkle_root(hashes: DataFrame, width: int = 3) -> DataFrame:
    """(root, files): the hash over all file hashes in path order.

    Groups of files (by the first ``width`` digits of their path's hash) are
    hashed first, then the groups' hashes, so no task concatenates all files.
    """
    groups = hashes.groupBy(F.substring(F.sha2("relative_path", 256), 1, width).alias("g")).agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("relative_path", "hash"))), lambda x: x["hash"]), ""), 256).alias("h"),
        F.count("*").alias("n"),
    )
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "")
    return groups.agg(F.sha2(ordered, 256).alias("root"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


def merkle_nodes(hashes: DataFrame) -> DataFrame:
    """(node, data, parent): the root and its leaves; a node's children are the rows that name it, so no row grows with the tree."""
    root = merkle_root(hashes).select("root")
    below = merkle_leaves(hashes).crossJoin(F.broadcast(root)).select("node", "data", F.col("root").alias("parent"))
    return below.unionByName(root.select(F.col("root").alias("node"), F.lit("root").alias("data"), F.lit(None).cast("string").alias("parent")))


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("parent").isNull())


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def children(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.filter(F.col("parent") == node)


def compare_dags(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node, change): added, removed, or modified (equal name, other data, which content-addressed names exclude)."""
    both = old.select("node", F.col("data").alias("old_data")).join(new.select("node", F.col("data").alias("new_data")), "node", "full_outer")
    change = F.when(F.col("old_data").isNull(), "added").when(F.col("new_data").isNull(), "removed").when(F.col("old_data") != F.col("new_data"), "modified")
    return both.select("node", change.alias("change")).filter("change IS NOT NULL")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(relative_path, change) between two tables of file hashes."""
    o, n = old.select("relative_path", F.col("hash").alias("o")), new.select("relative_path", F.col("hash").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("modified")
    return o.join(n, "relative_path", "full_outer").filter(~F.col("o").eqNullSafe(F.col("n"))).select("relative_path", change.alias("change"))


def apply_changes(old: DataFrame, new: DataFrame, changes: DataFrame, key: str = "relative_path") -> DataFrame:
    """Rows of ``old`` whose key is not removed or modified, and rows of ``new`` whose key is added or modified."""
    gone = changes.filter("change IN ('removed', 'modified')").select(key)
    come = changes.filter("change IN ('added', 'modified')").select(key)
    return old.join(gone, key, "left_anti").unionByName(new.join(come, key, "left_semi"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` without those whose key is listed; unknown keys are ignored."""
    return rows.join(keys.select(key), key, "left_anti")


def lookup_batch(rows: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Every wanted key (with its ``ordinal``) and its row, nulls where there is none."""
    return wanted.join(rows, key, "left")
