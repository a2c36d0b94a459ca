"""Settings of the engine; every field is in force where it is named."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from tessera.functions.languages import DEFAULT_EXTENSIONS


@dataclass(frozen=True)
class EmbeddingConfig:
    provider: str = "openai"  # openai, ollama or hashing
    api_key: str | None = None
    model: str = "text-embedding-3-small"
    base_url: str | None = None
    batch_size: int = 16
    dimension: int = 256  # of the hashing provider
    retries: int = 3


@dataclass(frozen=True)
class SearchConfig:
    default_limit: int = 10
    max_limit: int = 50
    candidates: int = 50  # per leg
    min_score: float | None = None
    rrf_k: int = 100
    approximate: bool = False  # vectors of near buckets only, from a stored index, instead of all
    snippet_bytes: int = 5000


@dataclass(frozen=True)
class IndexingConfig:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    max_chunks: int = 450_000
    max_file_bytes: int = 1_000_000
    extensions: tuple[str, ...] = DEFAULT_EXTENSIONS
    ignore_patterns: tuple[str, ...] = ()
    include_hidden: bool = False


@dataclass(frozen=True)
class Config:
    data_dir: str = "./data"
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    indexing: IndexingConfig = field(default_factory=IndexingConfig)

    @staticmethod
    def from_env(env: dict[str, str] | None = None, env_file: str = ".env") -> Config:
        """Defaults overridden by environment variables, which in turn override those of an env file."""
        known = {**_read_env_file(env_file), **(os.environ if env is None else env)}
        whole = lambda name, default: int(known.get(name, default))
        base = Config()
        provider = known.get("EMBEDDING_PROVIDER", base.embedding.provider).lower()
        if provider not in ("openai", "ollama", "hashing"):
            provider = "openai"
        least = known.get("MIN_SCORE")
        return Config(
            data_dir=known.get("DATA_DIR", base.data_dir),
            embedding=EmbeddingConfig(
                provider=provider,
                api_key=known.get("OPENAI_API_KEY"),
                model=known.get("EMBEDDING_MODEL", base.embedding.model),
                base_url=known.get("EMBEDDING_BASE_URL"),
                batch_size=whole("BATCH_SIZE", base.embedding.batch_size),
            ),
            search=SearchConfig(default_limit=whole("DEFAULT_TOP_K", 10), min_score=None if least is None else float(least), rrf_k=whole("RRF_K", 100), approximate=known.get("APPROXIMATE", "").lower() in ("1", "true", "yes")),
            indexing=IndexingConfig(
                chunk_size=whole("CHUNK_SIZE", 1000), chunk_overlap=whole("CHUNK_OVERLAP", 200), max_chunks=whole("MAX_CHUNKS", 450_000)
            ),
        )


def _read_env_file(path: str) -> dict[str, str]:
    found = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                name, eq, value = line.strip().removeprefix("export ").partition("=")
                if eq and name and not name.startswith("#"):
                    found[name.strip()] = value.strip().strip("'\"")
    return found
