"""What can go wrong, by kind; ``kind`` names it in messages."""

from __future__ import annotations


class EngineError(Exception):
    kind = "Unknown error"

    def __str__(self) -> str:
        return f"{self.kind}: {super().__str__()}"


class VectorStoreError(EngineError):
    kind = "Vector database error"


class FullTextError(EngineError):
    kind = "Full-text search error"


class EmbeddingError(EngineError):
    kind = "Embedding error"


class ConfigError(EngineError):
    kind = "Configuration error"


class NotIndexedError(EngineError):
    kind = "Codebase not indexed"


class InvalidPathError(EngineError):
    kind = "Invalid path"


class UnsupportedLanguageError(EngineError):
    kind = "Unsupported language"


class StatusError(EngineError):
    kind = "Snapshot error"
