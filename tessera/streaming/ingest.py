"""Keeping chunk tables current from a stream of file versions.

The engine's own sync is pulled (``Engine.analyze_code``).  Where files arrive as
a stream of (path, relative_path, ext, language, content), ``keep_current`` cuts
each micro-batch and appends its chunks, by language, and the list of its files;
``current`` reads what holds now: of every file the chunks of its newest version,
none where that version gave none.  So a batch costs what it brings, whatever the
size of the table.  ``compact`` writes what holds now as a table of its own.

The newest version of a file is the one of the largest ``order``, whichever batch
brought it; null is the smallest.  Of unlike contents with one order the one with the larger
hash is newer, a content is newer than none, and of equal rows one counts.  So any
order of batches, and batches that come twice, lead to the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.chunking import CHUNK_TYPE, chunk_files

#: What makes one version of a file newer than another.
_AGE = ("order", "hash")


def _aged(files: DataFrame, order: str) -> DataFrame:
    return files.withColumn("order", F.col(order)).withColumn("hash", F.coalesce(F.sha2(F.col("content").cast("binary"), 256), F.lit("")))


def latest(files: DataFrame, order: str) -> DataFrame:
    """The newest version of each path, one row; only hashes meet by path before the rows do."""
    aged = _aged(files, order)
    newest = aged.groupBy("path").agg(F.max(F.struct(*_AGE)).alias("newest"))
    kept = aged.join(newest, "path").filter(F.struct(*_AGE).eqNullSafe(F.col("newest")))
    return kept.dropDuplicates(["path"]).drop("newest")


def keep_current(files: DataFrame, target: str, checkpoint: str, order: str = "version", **options) -> StreamingQuery:
    """Write the chunks of every micro-batch's newest files to ``target``/batch=<n>, their versions to ``target``/_files; rerun batches overwrite themselves.

    A row with null content says that its file is gone.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            newest = latest(batch, order)
            cut = chunk_files(newest.filter("content IS NOT NULL"), **options)
            cut.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("language").parquet(f"{target}/batch={number}")
            # what makes the batch count comes last
            newest.select("path", *_AGE).write.mode("overwrite").parquet(f"{target}/_files/batch={number}")
        finally:
            batch.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, target: str) -> DataFrame:
    """(file_path, batch): which batch brought the newest version of each file."""
    listed = spark.read.parquet(f"{target}/_files")
    newest = listed.groupBy(F.col("path").alias("file_path")).agg(F.max(F.struct(*_AGE, "batch")).alias("newest"))
    return newest.select("file_path", F.col("newest.batch").alias("batch"))


def written(spark: SparkSession, target: str) -> DataFrame:
    """All chunks of all batches, with ``batch``; batches that only removed files have none."""
    return spark.read.schema(f"{CHUNK_TYPE}, batch int").parquet(target)


def current(spark: SparkSession, target: str) -> DataFrame:
    """The chunks that hold now."""
    chunks = written(spark, target)
    return chunks.join(versions(spark, target), ["file_path", "batch"], "left_semi").select([c for c in chunks.columns if c != "batch"])


def compact(spark: SparkSession, target: str, path: str) -> None:
    current(spark, target).write.mode("overwrite").parquet(path)
