"""Codebases as tables of files.

The driver reads the uppermost folders only, until there are enough for all
workers; they walk what lies below, each folder with the ignore rules that hold for
it, and read the files.  The root is a path or a URI (``tessera.sources.files``).  Files that are not UTF-8, or vanish meanwhile, are skipped.  Of files over
the size cap, which give no chunks, only the hash is taken, block by block.
"""

from __future__ import annotations

import hashlib
import os
import pickle
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.batches import ship
from tessera.functions.languages import DEFAULT_EXTENSIONS, language_of, with_dots
from tessera.functions.paths import file_extension, relative_path
from tessera.sources import files as places
from tessera.sources.ignore import Walk, walk

FILE_TYPE = "path string, content string"
READ_TYPE = "path string, content string, n_bytes long, hash string"
BLOCK = 1 << 20
FOLDERS = 256


def _ext(path: str) -> str:
    name = os.path.basename(path)
    return "" if name.rfind(".") <= 0 else name[name.rfind(".") :]


def list_files(root: str, extensions=DEFAULT_EXTENSIONS, custom_extensions=(), ignore_patterns=(), hidden: bool = False) -> list[str]:
    """Paths below ``root`` with one of the extensions (case-sensitive), in order, all read here."""
    wanted = {*extensions, *with_dots(custom_extensions)}
    return sorted(p for p in walk(root, ignore_patterns, hidden) if _ext(p) in wanted)


def paths_below(spark: SparkSession, root: str, extensions=DEFAULT_EXTENSIONS, custom_extensions=(), ignore_patterns=(), hidden: bool = False) -> DataFrame:
    """(path): what ``list_files`` lists, walked by the workers."""
    wanted, whole = {*extensions, *with_dots(custom_extensions)}, Walk(root, ignore_patterns, hidden)
    met, left = whole.spread(FOLDERS)

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                found = [p for p in whole.below([pickle.loads(folder)]) if _ext(p) in wanted]
                for i in range(0, len(found), 10_000):
                    yield pd.DataFrame({"path": found[i : i + 10_000]})

    near = spark.createDataFrame([(p,) for p in met if _ext(p) in wanted], "path string")
    if not left:
        return near
    folders = spark.createDataFrame([(pickle.dumps(f),) for f in left], "folder binary").repartition(len(left))
    return near.unionByName(folders.mapInPandas(below, "path string"))


def _read(path: str) -> str | None:
    try:
        with places.opened(path) as f:
            return f.read().decode("utf-8")
    except (OSError, UnicodeDecodeError):
        return None


def _measure(path: str, most: int) -> tuple[str | None, int, str] | None:
    """(content, size, SHA-256); no content over ``most`` bytes; None for what can't be read as text."""
    try:
        if places.size(path) <= most:
            with places.opened(path) as f:
                raw = f.read()
            return raw.decode("utf-8"), len(raw), hashlib.sha256(raw).hexdigest()
        digest, size = hashlib.sha256(), 0
        with places.opened(path) as f:
            while block := f.read(BLOCK):
                digest.update(block)
                size += len(block)
        return None, size, digest.hexdigest()
    except (OSError, UnicodeDecodeError):
        return None


def with_names(files: DataFrame, root: str) -> DataFrame:
    """(path, relative_path, ext, language, content, n_bytes, hash) of files (path, content, n_bytes, hash)."""
    named = files.withColumn("ext", file_extension(F.col("path")))
    return named.select(
        "path", relative_path(F.col("path"), root).alias("relative_path"), "ext", language_of(F.col("ext")).alias("language"), "content",
        "n_bytes", "hash",
    )


def scan(spark: SparkSession, root: str, max_bytes: int = 1_000_000, **options) -> DataFrame:
    """The files of a codebase: (path, relative_path, ext, language, content, n_bytes, hash)."""
    root = places.absolute(root)
    ship(spark)
    listed = paths_below(spark, root, **options)
    slices = spark.sparkContext.defaultParallelism * 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch["path"].iloc[i : i + 64]
                found = [(p, *got) for p in part if (got := _measure(p, max_bytes)) is not None]
                yield pd.DataFrame(found, columns=["path", "content", "n_bytes", "hash"])

    return with_names(listed.repartition(slices, "path").mapInPandas(run, READ_TYPE), root)


class CodebaseSource(DataSource):
    """``spark.read.format("codebase").load(root)``; options custom_extensions and ignore_patterns are comma-separated."""

    @classmethod
    def name(cls) -> str:
        return "codebase"

    def schema(self) -> str:
        return FILE_TYPE

    def reader(self, schema) -> DataSourceReader:
        return _CodebaseReader(self.options)


class _CodebaseReader(DataSourceReader):
    def __init__(self, options):
        self.root = places.absolute(options["path"])
        self.custom, self.ignored = ([x for x in options.get(k, "").split(",") if x] for k in ("custom_extensions", "ignore_patterns"))

    def partitions(self):
        """Files that were met near the root, and the folders below it."""
        met, left = Walk(self.root, self.ignored).spread(FOLDERS)
        parts = [(met[i : i + 256], []) for i in range(0, len(met), 256)] + [([], [folder]) for folder in left]
        return [InputPartition(p) for p in parts] or [InputPartition(([], []))]

    def read(self, partition):
        wanted, (paths, folders) = {*DEFAULT_EXTENSIONS, *with_dots(self.custom)}, partition.value
        for path in chain(paths, Walk(self.root, self.ignored).below(folders)):
            if _ext(path) in wanted and (content := _read(path)) is not None:
                yield path, content


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(CodebaseSource)
