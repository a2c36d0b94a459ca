"""Which codebases are indexed, are being indexed, or failed: a small JSON file on the driver."""

from __future__ import annotations

import json
import threading
from datetime import UTC, datetime

from tessera import messages
from tessera.errors import StatusError
from tessera.sources import files
from tessera.sources.files import Hadoop, Local

VERSION = "v2"


def _now() -> str:
    return datetime.now(UTC).isoformat()


def _vanished(path: str) -> bool:
    """Whether a path surely isn't there; a file system that can't be reached says nothing."""
    try:
        return files.kind(path) is None
    except (OSError, ValueError):
        return False


class StatusBook:
    """Status by path.  Entries whose path has vanished are left out when the file is read.

    ``place`` reads and writes the file: the local file system, or Spark's.
    """

    def __init__(self, path: str, place: Local | Hadoop | None = None):
        self.path, self.lock, self.place = path, threading.RLock(), place or Local()
        self.entries: dict[str, dict] = {}
        try:
            self.load()
        except FileNotFoundError:
            pass

    def load(self) -> None:
        try:
            found = json.loads(self.place.read(self.path))
            if found["formatVersion"] != VERSION:
                raise KeyError(f"version {found['formatVersion']}")
            self.entries = {p: e for p, e in found["codebases"].items() if not _vanished(p)}
        except (ValueError, KeyError, TypeError) as problem:
            raise StatusError(f"{self.path}: {problem}") from problem

    def save(self) -> None:
        with self.lock:
            saved = {"formatVersion": VERSION, "codebases": self.entries, "lastUpdated": _now()}
            self.place.replace(self.path, json.dumps(saved, indent=2).encode())

    def _set(self, path: str, **entry) -> None:
        with self.lock:
            self.entries[path] = entry | {"lastUpdated": _now()}

    def set_indexing(self, path: str, percentage: int) -> None:
        self._set(path, status="indexing", indexingPercentage=max(0, min(100, int(percentage))))

    def set_indexed(self, path: str, files: int, chunks: int, index_status: str = "completed") -> None:
        self._set(path, status="indexed", indexedFiles=files, totalChunks=chunks, indexStatus=index_status)

    def set_failed(self, path: str, message: str, percentage: int | None = None) -> None:
        extra = {} if percentage is None else {"lastAttemptedPercentage": percentage}
        self._set(path, status="indexfailed", errorMessage=message, **extra)

    def remove(self, path: str) -> None:
        with self.lock:
            self.entries.pop(path, None)

    def get(self, path: str) -> dict | None:
        return self.entries.get(path)

    def status(self, path: str) -> str:
        """indexed, indexing, indexfailed or not_found."""
        return self.entries.get(path, {}).get("status", "not_found")

    def is_indexed(self, path: str) -> bool:
        return self.status(path) == "indexed"

    def is_indexing(self, path: str) -> bool:
        return self.status(path) == "indexing"

    def progress(self, path: str) -> int:
        return self.entries.get(path, {}).get("indexingPercentage", 0)

    def paths(self, status: str) -> list[str]:
        return sorted(p for p, e in self.entries.items() if e["status"] == status)


def epoch(stamp: str) -> int:
    """Seconds since 1970 of an RFC 3339 time; 0 for anything else."""
    try:
        return int(datetime.fromisoformat(stamp).timestamp())
    except ValueError:
        return 0


def shown_time(stamp: str) -> str:
    try:
        return datetime.fromisoformat(stamp).astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S")
    except ValueError:
        return "unknown"


def message(path: str, entry: dict | None) -> str:
    """The status of a codebase in words."""
    if entry is None:
        return messages.STATUS_UNKNOWN.format(path=path)
    when = shown_time(entry["lastUpdated"])
    if entry["status"] == "indexed":
        return messages.STATUS_INDEXED.format(path=path, files=entry["indexedFiles"], chunks=entry["totalChunks"], status=entry["indexStatus"], when=when)
    if entry["status"] == "indexing":
        done = entry["indexingPercentage"]
        hint = messages.HINT_SCANNING if done < 10 else messages.HINT_EMBEDDING if done < 100 else ""
        return messages.STATUS_INDEXING.format(path=path, done=done, hint=hint, when=when)
    at = entry.get("lastAttemptedPercentage") or 0
    reached = messages.FAILED_PROGRESS.format(at=at) if at > 0 else ""
    return messages.STATUS_FAILED.format(path=path, error=entry["errorMessage"], reached=reached, when=when)
