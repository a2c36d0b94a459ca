"""Versioned Parquet tables of one codebase.

``<data_dir>/<key>/gen=<n>/{chunks,vectors,postings,doc_len,signatures,file_hashes}``
plus a ``CURRENT`` file that is replaced as a whole: a generation holds data and
file hashes together, readers keep the generation they opened, and a failed write
leaves the one before in force.

A generation is a stack of layers, named by its ``MANIFEST.json``: a base, and the
deltas of later syncs.  A delta has the rows of new and changed files, and the names
of what they replace: ``dead_files`` and the ``dead_ids`` of their chunks.  Readers
take all layers and leave out, by one anti-join, what a later layer names; so a sync
writes as much as its changes.  Where deltas get many or large, ``compact`` writes
the stack out as a new base, in as many files as its bytes ask for.

The data folder is a path or URI of any file system that Spark writes to.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.operators.chunking import CHUNK_TYPE
from tessera.sources import files
from tessera.sources.files import Hadoop

SCHEMAS = {
    "chunks": CHUNK_TYPE,
    "vectors": "id string, vector array<float>",
    "postings": "id string, term string, pos long",
    "doc_len": "id string, dl long",
    "signatures": "tbl int, bucket int, id string",
    "file_hashes": "relative_path string, hash string",
    "dead_files": "relative_path string",
    "dead_ids": "id string",
}
TABLES = [name for name in SCHEMAS if not name.startswith("dead_")]
#: The columns in whose order each table lies, as its lookups ask for.
ORDER = {"chunks": ["id"], "vectors": ["id"], "postings": ["term", "id", "pos"], "doc_len": ["id"], "signatures": ["tbl", "bucket", "id"], "file_hashes": ["relative_path"]}
KEPT = 2
#: Deltas are merged into the base when there are more than so many, or when they have this share of its bytes and are worth it.
MOST_DELTAS, DELTA_SHARE, WORTH_BYTES = 16, 0.25, 64 << 20
FILE_BYTES = 128 << 20


def store_key(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:16]


class Store:
    def __init__(self, spark: SparkSession, data_dir: str, codebase: str):
        self.spark, self.data_dir, self.files = spark, files.absolute(data_dir), Hadoop(spark)
        self.folder = posixpath.join(self.data_dir, store_key(codebase))

    @property
    def current(self) -> int | None:
        try:
            return int(self.files.read(posixpath.join(self.folder, "CURRENT")))
        except FileNotFoundError:
            return None

    def _path(self, generation: int, name: str) -> str:
        return posixpath.join(self.folder, f"gen={generation}", name)

    def layers(self, generation: int | None = None) -> list[dict]:
        """The layers of a generation (the current one), the base first: {gen, tables}."""
        at = self.current if generation is None else generation
        if at is None:
            return []
        try:
            return json.loads(self.files.read(self._path(at, "MANIFEST.json")))["layers"]
        except FileNotFoundError:
            return []

    def read(self, name: str, generation: int | None = None) -> DataFrame:
        """A table of a generation (the current one); empty where there is none."""
        layers = self.layers(generation)
        held = [layer["gen"] for layer in layers if name in layer["tables"]]
        if not held:
            return self.spark.createDataFrame([], SCHEMAS[name])
        one = lambda table, g: self.spark.read.schema(SCHEMAS[table]).parquet(self._path(g, table))
        key = "relative_path" if name in ("chunks", "file_hashes") else "id"
        dead = "dead_files" if key == "relative_path" else "dead_ids"
        later = [layer["gen"] for layer in layers if dead in layer["tables"] and layer["gen"] > held[0]]
        if not later:
            return reduce(DataFrame.unionByName, (one(name, g) for g in held))
        rows = reduce(DataFrame.unionByName, (one(name, g).withColumn("layer", F.lit(g)) for g in held))
        gone = reduce(DataFrame.unionByName, (one(dead, g).withColumn("until", F.lit(g)) for g in later))
        gone = gone.groupBy(F.col(key).alias("gone")).agg(F.max("until").alias("until"))
        return rows.join(gone, (F.col(key) == F.col("gone")) & (F.col("layer") < F.col("until")), "left_anti").drop("layer")

    def commit(self, tables: dict[str, DataFrame], replaced: DataFrame | None = None) -> int:
        """Write a new generation and make it current; older generations' but the last's files go.

        ``replaced`` (relative_path) names the files whose rows so far no longer hold;
        where it is None, all of them are.
        """
        before = self.current
        new = self._claim()
        if replaced is not None and before is not None:
            chunks = self.read("chunks", before).join(replaced, "relative_path", "left_semi")
            tables = tables | {"dead_files": replaced.select("relative_path"), "dead_ids": chunks.select("id")}
        for name, df in tables.items():
            keys = ORDER.get(name)
            laid = df.repartitionByRange(*keys[:1]).sortWithinPartitions(*keys) if keys else df.coalesce(1)
            laid.write.mode("overwrite").parquet(self._path(new, name))
        own = {"gen": new, "tables": sorted(tables)}
        return self._publish(new, before, [own] if replaced is None or before is None else [*self.layers(before), own])

    def _claim(self) -> int:
        """A generation number that no other writer has: making its folder succeeds once."""
        new = (self.current or 0) + 1
        while not self.files.claim(posixpath.join(self.folder, f"gen={new}")):
            new += 1
        return new

    def _publish(self, new: int, before: int | None, layers: list[dict]) -> int:
        if self.current != before:
            self.files.remove(posixpath.join(self.folder, f"gen={new}"))
            raise EngineError("another run has changed the index meanwhile")
        self.files.write(self._path(new, "MANIFEST.json"), json.dumps({"layers": layers}).encode())
        self.files.replace(posixpath.join(self.folder, "CURRENT"), str(new).encode())
        self._tidy(new, before)
        return new

    def size(self, layers: list[dict], tables: list[str] = TABLES) -> int:
        """Bytes of the files of some layers."""
        found = (self._path(layer["gen"], name) for layer in layers for name in layer["tables"] if name in tables)
        return sum(map(self.files.bytes_below, found))

    def due(self) -> bool:
        """Whether the current generation's deltas should be merged."""
        base, *deltas = self.layers() or [{"gen": 0, "tables": []}]
        written = self.size(deltas)
        return len(deltas) > MOST_DELTAS or (written > WORTH_BYTES and written > DELTA_SHARE * self.size([base]))

    def compact(self) -> int:
        """Write the current generation as one base, in files of about ``FILE_BYTES``."""
        before, layers = self.current, self.layers()
        new = self._claim()
        for name in TABLES:
            parts = max(1, -(-self.size(layers, [name]) // FILE_BYTES))
            self.read(name, before).repartitionByRange(parts, ORDER[name][0]).sortWithinPartitions(*ORDER[name]).write.mode("overwrite").parquet(self._path(new, name))
        return self._publish(new, before, [{"gen": new, "tables": TABLES}])

    def _tidy(self, new: int, before: int | None) -> None:
        """Remove what the last ``KEPT`` generations don't read; folders that a writer still fills are newer than these."""
        last = sorted({g for g in (new, before) if g is not None})[-KEPT:]
        used = {layer["gen"] for n in last for layer in self.layers(n)} | set(last)
        for entry in self.files.names(self.folder):
            if entry.startswith("gen=") and int(entry[4:]) < new and int(entry[4:]) not in used:
                self.files.remove(posixpath.join(self.folder, entry))

    def exists(self) -> bool:
        return self.current is not None

    def has_rows(self, name: str) -> bool:
        return bool(self.read(name).head(1))

    def counts(self) -> dict[str, int]:
        return {name: self.read(name).count() for name in ("chunks", "vectors", "doc_len", "file_hashes")}

    def drop(self) -> None:
        """Remove everything; nothing outside the data folder is touched."""
        if self.folder == posixpath.join(self.data_dir, posixpath.basename(self.folder)) and self.folder != self.data_dir:
            self.files.remove(self.folder)
