"""Embedders: two HTTP services and a local one that hashes terms."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import EmbeddingConfig
from tessera.errors import ConfigError, EmbeddingError
from tessera.functions.text import MAX_TOKEN_BYTES

#: Token limits of models; others of the local service have the smaller one.
OPENAI_TOKENS, OLLAMA_TOKENS = 8192, 2048
LONGER_MODELS = ("nomic-embed-text", "snowflake-arctic-embed")


class Embedder(Protocol):
    name: str
    max_tokens: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


def prepared(text: str, max_tokens: int) -> str:
    """A space for nothing; of a text over 4 * max_tokens bytes, its first 4 * max_tokens characters."""
    most = max_tokens * 4
    return " " if not text else text[:most] if len(text.encode("utf-8", "surrogatepass")) > most else text


def embed_texts(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    got = embedder.embed_batch([prepared(t, embedder.max_tokens) for t in texts])
    if len(got) != len(texts):
        raise EmbeddingError(f"{len(got)} vectors for {len(texts)} texts")
    return got


def dimension(embedder: Embedder) -> int:
    """Length of the embedder's vectors, found by embedding a word."""
    return len(embed_texts(embedder, ["test"])[0])


def _post(url: str, body: dict, headers: dict[str, str], retries: int) -> dict:
    data = json.dumps(body).encode()
    for attempt in range(retries):
        try:
            request = urllib.request.Request(url, data, {"Content-Type": "application/json", **headers})
            with urllib.request.urlopen(request, timeout=60) as answer:
                return json.load(answer)
        except (urllib.error.URLError, ValueError) as problem:
            refused = isinstance(problem, urllib.error.HTTPError) and problem.code < 500 and problem.code != 429
            if refused or attempt == retries - 1:
                raise EmbeddingError(f"{url}: {problem}") from problem
            time.sleep(2**attempt)
    raise EmbeddingError(f"{url}: no attempt allowed")


@dataclass
class OpenAIEmbedder:
    api_key: str
    model: str
    base_url: str = "https://api.openai.com/v1"
    retries: int = 3
    name: str = "OpenAI"
    max_tokens: int = OPENAI_TOKENS

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        body = {"model": self.model, "input": texts, "encoding_format": "float"}
        answer = _post(f"{self.base_url.rstrip('/')}/embeddings", body, {"Authorization": f"Bearer {self.api_key}"}, self.retries)
        return [row["embedding"] for row in sorted(answer["data"], key=lambda r: r.get("index", 0))]


@dataclass
class OllamaEmbedder:
    model: str
    base_url: str = "http://127.0.0.1:11434"
    retries: int = 3
    name: str = "Ollama"

    @property
    def max_tokens(self) -> int:
        return OPENAI_TOKENS if any(m in self.model for m in LONGER_MODELS) else OLLAMA_TOKENS

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return _post(f"{self.base_url.rstrip('/')}/api/embed", {"model": self.model, "input": texts}, {}, self.retries)["embeddings"]


@dataclass
class HashingEmbedder:
    """Counts of terms in hashed buckets, scaled to unit length: needs no service, and SQL can compute it too."""

    dimension: int = 256
    name: str = "Hashing"
    max_tokens: int = OPENAI_TOKENS

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for term in re.findall(r"[^\W_]+", text.lower()):
                if len(term.encode()) <= MAX_TOKEN_BYTES:
                    v[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % self.dimension] += 1
            size = math.sqrt(sum(x * x for x in v))
            out.append([x / size for x in v] if size else v)
        return out


def make_embedder(config: EmbeddingConfig) -> Embedder:
    if config.provider == "hashing":
        return HashingEmbedder(config.dimension)
    if config.provider == "ollama":
        return OllamaEmbedder(config.model, config.base_url or OllamaEmbedder.base_url, config.retries)
    if not config.api_key:
        raise ConfigError("the openai provider needs OPENAI_API_KEY")
    return OpenAIEmbedder(config.api_key, config.model, config.base_url or OpenAIEmbedder.base_url, config.retries)


def embedding(embedder: Embedder, text: Column, batch_size: int = 16) -> Column:
    """Vectors of a text column; any failure fails the query."""

    @F.pandas_udf("array<float>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, out = batch.tolist(), []
            for i in range(0, len(texts), batch_size):
                out += embed_texts(embedder, texts[i : i + batch_size])
            yield pd.Series(out)

    return of.asNondeterministic()(text)
