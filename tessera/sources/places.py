"""Folders for tables that a query or a job leaves behind."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of a name not taken before, under ``spark.checkpoint.dir``; where that is unset, and all runs in one local process, under a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master, application = spark.sparkContext.master, spark.sparkContext.applicationId
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _own.get(application) or _own.setdefault(application, tempfile.mkdtemp(prefix="tessera-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
