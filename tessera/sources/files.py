"""Folders and files by path or URI, where Spark's tables aren't meant.

Code is walked and read by the workers, which have no JVM: plain paths through
``os``, URIs (``file:``, ``hdfs:``, ``s3:``, ``gs:``, ``abfs:`` and what else Arrow
opens, with the credentials that Arrow finds) through Arrow's file systems.  The few
small files that the driver keeps beside its tables go through Hadoop's FileSystem
(``Hadoop``), under the session's settings, so they lie where Spark writes the tables.

A URI is written as Hadoop writes it: names stand as they are, not percent-encoded.
"""

from __future__ import annotations

import os
import posixpath
import re
import uuid
from contextlib import contextmanager
from functools import lru_cache
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyarrow import fs as arrow
from pyspark.sql import SparkSession

#: Scheme and authority; a drive letter is no scheme.
_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]+):(?://([^/]*))?(/.*)?\Z", re.S)
#: Hadoop's names of file systems that Arrow knows by another.
_ARROW_NAMES = {"s3a": "s3", "s3n": "s3"}


def split(path: str) -> tuple[str, str]:
    """(scheme and authority, path) of a URI; the first is empty for plain paths."""
    found = _URI.match(path)
    if not found or not (found[2] is not None or found[3]):
        return "", path
    return f"{found[1].lower()}://{found[2] or ''}", found[3] or "/"


def absolute(path: str) -> str:
    """The path or URI without dots, doubled slashes and a slash at the end."""
    prefix, rest = split(path)
    if not prefix:
        return os.path.abspath(os.path.expanduser(path))
    rest = posixpath.normpath("/" + rest.lstrip("/"))
    return prefix + rest


def parent(path: str) -> str:
    prefix, rest = split(path)
    return prefix + posixpath.dirname(rest) if prefix else os.path.dirname(path)


@lru_cache(maxsize=64)
def _opened(prefix: str) -> tuple[arrow.FileSystem, str]:
    """Arrow's file system of a prefix, and what its own paths begin with there."""
    scheme, authority = prefix.split("://", 1)
    system, probe = arrow.FileSystem.from_uri(f"{_ARROW_NAMES.get(scheme, scheme)}://{quote(authority, safe=':@')}/x")
    return system, probe[: -len("/x")]


def _within(path: str) -> tuple[arrow.FileSystem, str] | None:
    """Where a URI lies in Arrow's terms; None for plain paths."""
    prefix, rest = split(path)
    if not prefix:
        return None
    system, base = _opened(prefix)
    return system, base + rest


def kind(path: str) -> str | None:
    """"dir", "file", or None for what isn't there or is neither."""
    at = _within(path)
    if at is None:
        return "dir" if os.path.isdir(path) else "file" if os.path.isfile(path) else None
    found = at[0].get_file_info(at[1]).type
    return {arrow.FileType.Directory: "dir", arrow.FileType.File: "file"}.get(found)


def entries(folder: str) -> list[tuple[str, str, str]]:
    """(name, path, "dir" or "file") in a folder, by name; links and other things are left out.  OSError where it can't be read."""
    at = _within(folder)
    if at is None:
        with os.scandir(folder) as found:
            listed = [(e.name, e.path, "dir" if e.is_dir(follow_symlinks=False) else "file" if e.is_file(follow_symlinks=False) else "") for e in found]
    else:
        system, inner = at
        linked = os.path.islink if isinstance(system, arrow.LocalFileSystem) else lambda path: False
        kinds = {arrow.FileType.Directory: "dir", arrow.FileType.File: "file"}
        found = system.get_file_info(arrow.FileSelector(inner))
        listed = [(i.base_name, posixpath.join(folder, i.base_name), "" if linked(i.path) else kinds.get(i.type, "")) for i in found]
    return sorted(e for e in listed if e[2])


def size(path: str) -> int:
    at = _within(path)
    if at is None:
        return os.path.getsize(path)
    found = at[0].get_file_info(at[1])
    if found.type != arrow.FileType.File:
        raise FileNotFoundError(path)
    return found.size


def opened(path: str):
    """The file's bytes as a stream, to be closed by ``with``."""
    at = _within(path)
    return open(path, "rb") if at is None else at[0].open_input_stream(at[1])


class Local:
    """The driver's small files on a mounted file system."""

    def read(self, path: str) -> bytes:
        """FileNotFoundError where there is none."""
        with open(path, "rb") as f:
            return f.read()

    def replace(self, path: str, content: bytes) -> None:
        """Readers see the old content or the new one, whole."""
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        beside = f"{path}.{uuid.uuid4().hex}"
        with open(beside, "wb") as f:
            f.write(content)
        os.replace(beside, path)


class Hadoop:
    """The driver's small files on whatever file system Spark writes to."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        """(file system, Hadoop's path)."""
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.settings), at

    @contextmanager
    def _errors(self, path: str):
        try:
            yield
        except Py4JJavaError as problem:
            name = problem.java_exception.getClass().getSimpleName()
            kinds = {"FileNotFoundException": FileNotFoundError, "FileAlreadyExistsException": FileExistsError}
            raise kinds.get(name, OSError)(f"{path}: {problem.java_exception}") from problem

    def read(self, path: str) -> bytes:
        """FileNotFoundError where there is none."""
        with self._errors(path):
            system, at = self._at(path)
            stream = system.open(at)
            try:
                return bytes(stream.readAllBytes())
            finally:
                stream.close()

    def write(self, path: str, content: bytes) -> None:
        with self._errors(path):
            system, at = self._at(path)
            stream = system.create(at, True)
            try:
                stream.write(bytearray(content))
            finally:
                stream.close()

    def replace(self, path: str, content: bytes) -> None:
        """Readers see the old content or the new one, whole: written beside it and renamed.

        A file system without such a rename is an object store, where a written object appears whole.
        """
        with self._errors(path):
            system, at = self._at(path)
            try:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.makeQualified(at).toUri(), self.settings)
            except Py4JJavaError as problem:
                if problem.java_exception.getClass().getSimpleName() != "UnsupportedFileSystemException":
                    raise
                self.write(path, content)
                return
            beside = f"{path}.{uuid.uuid4().hex}"
            self.write(beside, content)
            rename = self.jvm.org.apache.hadoop.fs.Options.Rename
            options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
            options[0] = rename.OVERWRITE
            context.rename(self._at(beside)[1], at, options)

    def claim(self, folder: str) -> bool:
        """Make a folder; True for one caller only."""
        with self._errors(folder):
            system, at = self._at(folder)
            system.mkdirs(at.getParent())
            if system.getUri().getScheme() == "file":  # here create() looks first and writes then, mkdir doesn't
                try:
                    os.mkdir(at.toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            if system.exists(at):
                return False
            try:
                system.create(self.jvm.org.apache.hadoop.fs.Path(at, "_claimed"), False).close()
                return True
            except Py4JJavaError as problem:
                if problem.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                    return False
                raise

    def names(self, folder: str) -> list[str]:
        with self._errors(folder):
            system, at = self._at(folder)
            return sorted(found.getPath().getName() for found in system.listStatus(at))

    def bytes_below(self, path: str) -> int:
        """Bytes of all files in and below a folder; 0 where there is none."""
        with self._errors(path):
            system, at = self._at(path)
            return int(system.getContentSummary(at).getLength()) if system.exists(at) else 0

    def remove(self, folder: str) -> None:
        with self._errors(folder):
            system, at = self._at(folder)
            system.delete(at, True)
