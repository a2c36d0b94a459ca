"""What the training-data operators share: tables, shared files, words.

A *word* is everywhere a maximal run of characters other than space and
``\\t\\n\\v\\f\\r`` (pattern ``WORD``).  On UTF-8 bytes that is exactly what
``bytes.split()`` returns, which is what the Python workers use.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.batches import small_batches

_own_dirs: dict[str, str] = {}
_records: list[list[str]] = []
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is taken from the session; only where that is unset, and everything runs in
    one local process, a temporary folder is made and kept for the application.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_dirs.setdefault(spark.sparkContext.applicationId, "") or _own_dir(spark.sparkContext.applicationId)


def _own_dir(application: str) -> str:
    _own_dirs[application] = tempfile.mkdtemp(prefix="tessera-")
    return _own_dirs[application]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    for made in _records:
        made.append(path)
    return path


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that are taken in the shared folder meanwhile."""
    made: list[str] = []
    _records.append(made)
    try:
        yield made
    finally:
        _records.remove(made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` made and nothing reads any more."""
    spark = df.sparkSession
    for path in read_paths(df)[:1]:
        remove(spark, [path])


def read_paths(df: DataFrame) -> list[str]:
    """The folders of this module's making that ``df`` reads."""
    folders = dict.fromkeys(file.rpartition("/")[0] for file in df.inputFiles())
    return [f for f in folders if f.rpartition("/")[2].startswith("tessera-")]


def clear(spark: SparkSession) -> int:
    """Delete all tables that ``materialize`` and ``fresh_path`` left in the shared folder; results not yet written depend on them."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessera-*-*")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(pattern) or []
    for entry in found:
        files.delete(entry.getPath(), True)
    return len(found)


def crc_mod(col: str, k: int) -> Column:
    """crc32 of an id as text, modulo k; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("null"))) % k


def word_list(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text as UTF-8 bytes, A-Z lower-cased on demand."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


__all__ = ["WORD", "clear", "crc_mod", "discard", "fresh_path", "materialize", "read_paths", "recorded", "remove", "shared_dir", "small_batches", "table", "word_list"]
