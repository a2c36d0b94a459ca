"""Incremental chunking of a growing folder of documents.

A file stream with a checkpoint takes the Parquet files that came since the last
run, maps documents to files of a codebase and appends their chunks by language
(``tessera.streaming.ingest``).  A document that comes again replaces its chunks, one
with a null text removes them; which version holds is decided by ``version_column``,
or, where the table has none, by content.  What holds is read by ``read``.  A run
with nothing new writes nothing; a run that broke off is taken up by the next, which
writes the same batches over.

    spark-submit jobs/ingest_chunks.py --source /data/documents --target /data/chunks --checkpoint /data/chunks.checkpoint
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from jobs.settings import command_line
from tessera.plans.corpus import as_files
from tessera.streaming import ingest

log = logging.getLogger("jobs.ingest_chunks")
SETTINGS = {"source": "", "target": "", "checkpoint": "", "version_column": "none", "size": 1000, "overlap": 200, "splitter": "langchain", "files_per_batch": 1000}


def _pattern(source: str) -> str:
    """``source`` as a pattern that only it matches: a file stream takes a folder or a pattern, and this names a single file as well."""
    return source if any(c in source for c in "*?[{") else f"{source.rstrip('/')[:-1]}[{source.rstrip('/')[-1]}]"


def run(spark: SparkSession, source: str, target: str, checkpoint: str, version_column: str = "none", size: int = 1000, overlap: int = 200, splitter: str = "langchain", files_per_batch: int = 1000) -> dict:
    """Take what is new in ``source``; returns the rows read and the batches and chunks written."""
    known = spark.read.parquet(source).schema
    new = spark.readStream.schema(known).option("maxFilesPerTrigger", files_per_batch).parquet(_pattern(source))
    version = F.lit(0) if version_column == "none" else F.col(version_column)
    files = as_files(new.withColumn("version", version), "version")
    stream = ingest.keep_current(files, target, checkpoint, "version", size=size, overlap=overlap, splitter=splitter, max_bytes=None)
    stream.awaitTermination()
    batches = {p["batchId"]: p["numInputRows"] for p in stream.recentProgress if p["numInputRows"]}
    done = {"rows": sum(batches.values()), "batches": len(batches), "chunks": 0}
    if batches:
        done["chunks"] = ingest.written(spark, target).filter(F.col("batch").isin(list(batches))).count()
    log.info("read %d new rows of %s in %d batches", done["rows"], source, done["batches"])
    log.info("wrote %d chunks to %s", done["chunks"], target)
    return done


def read(spark: SparkSession, target: str) -> DataFrame:
    """The chunks that hold after the runs so far."""
    return ingest.current(spark, target)


if __name__ == "__main__":
    sys.exit(command_line(run, SETTINGS, str(Path(__file__).with_suffix(".json")), __doc__))
