"""Nightly build of the full-text index of a document table.

Reads documents, computes the block-max postings that ranked search reads
(``tessera.operators.blockmax``), and writes them by bucket of terms under
``target``/postings, and the length and block of every document under
``target``/documents by length class.  Both are replaced as a whole, so a rerun, also
after a run that broke off, leaves the same tables.  Rows without an id are left out.

    spark-submit jobs/build_index.py --source /data/documents.parquet --target /data/index
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from jobs.settings import command_line, shuffles_cleaned
from tessera.operators import blockmax

log = logging.getLogger("jobs.build_index")
SETTINGS = {"source": "", "target": "", "format": "parquet", "id_column": "doc_id", "text_column": "text", "buckets": blockmax.BUCKETS, "block_docs": blockmax.BLOCK_DOCS}


def run(spark: SparkSession, source: str, target: str, format: str = "parquet", id_column: str = "doc_id", text_column: str = "text", buckets: int = blockmax.BUCKETS, block_docs: int = blockmax.BLOCK_DOCS) -> dict:
    """Build the index of ``source`` into ``target``; returns what was read and written."""
    docs = spark.read.format(format).load(source).select(F.col(id_column).alias("id"), F.col(text_column).alias("content")).filter("id IS NOT NULL")
    # texts are split once and then read several times; they lie on the executors' disks meanwhile
    texts = blockmax.worded(docs).persist(StorageLevel.DISK_ONLY)
    try:
        with shuffles_cleaned(spark):
            sized = texts.select("id", F.coalesce("dl", F.lit(0)).cast("long").alias("dl"))
            sized = sized.withColumn("class", blockmax.length_class(F.col("dl")))
            # classes differ in size; each is written by as many tasks as it needs
            sized.hint("rebalance", "class").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("class").parquet(f"{target}/documents")
            blockmax.write(blockmax.inverted(texts, block_docs, buckets), f"{target}/postings")
    finally:
        texts.unpersist(blocking=True)
    documents, postings = spark.read.parquet(f"{target}/documents"), spark.read.schema("bucket int, term string, docs long").parquet(f"{target}/postings")
    size = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first().asDict()
    done = size | postings.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("docs"), F.lit(0)).alias("postings")).first().asDict()
    log.info("read %d documents, %d tokens of %s", done["documents"], done["tokens"], source)
    log.info("wrote %d postings in %d blocks to %s/postings, %d rows to %s/documents", done["postings"], done["blocks"], target, done["documents"], target)
    return done


def read(spark: SparkSession, target: str) -> DataFrame:
    """The postings of an index: (bucket, term, block, df, docs, top, ids, parts)."""
    return spark.read.parquet(f"{target}/postings")


if __name__ == "__main__":
    sys.exit(command_line(run, SETTINGS, str(Path(__file__).with_suffix(".json")), __doc__))
