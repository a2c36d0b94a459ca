"""The engine's four tools: index a codebase, search it, drop its index, tell its status.

Answers are dictionaries; mistakes of the caller are answers with an ``error``,
not exceptions.  Indexing runs in a thread of its own and searches meanwhile use
the generation that was complete before.
"""

from __future__ import annotations

import json
import posixpath
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import messages
from tessera.batches import ship
from tessera.config import Config
from tessera.errors import EngineError, InvalidPathError
from tessera.operators import bm25, chunking, fusion, sync, vector
from tessera.sources import files as places
from tessera.sources import scan, status
from tessera.sources.embedding import Embedder, dimension, embed_texts, embedding, make_embedder
from tessera.sources.files import Hadoop, absolute
from tessera.sources.status import StatusBook
from tessera.sources.store import Store


def checked_path(path: str) -> str:
    full = absolute(path)
    try:
        kind = places.kind(full)
    except (OSError, ValueError) as problem:
        raise InvalidPathError(f"Path '{full}' can't be read: {problem}. Original input: '{path}'") from problem
    if kind is None:
        raise InvalidPathError(f"Path '{full}' does not exist. Original input: '{path}'")
    if kind != "dir":
        raise InvalidPathError(f"Path '{full}' is not a directory. Original input: '{path}'")
    return full


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None, embedder: Embedder | None = None):
        ship(spark)
        self.spark, self.config = spark, config or Config.from_env()
        self.embedder = embedder or make_embedder(self.config.embedding)
        self.dimension = dimension(self.embedder)
        self.book = StatusBook(posixpath.join(absolute(self.config.data_dir), "snapshot.json"), Hadoop(spark))
        self.pool = ThreadPoolExecutor(max_workers=2)
        self.running: dict[str, Future] = {}
        self.stores: dict[str, Store] = {}

    def store(self, path: str) -> Store:
        if path not in self.stores:
            self.stores[path] = Store(self.spark, self.config.data_dir, path)
        return self.stores[path]

    # -- analyze_code --------------------------------------------------------

    def analyze_code(self, path: str, force: bool = False, splitter: str = "ast", custom_extensions=(), ignore_patterns=()) -> dict:
        """Start indexing in the background; what has not changed since the last time is kept unless ``force``."""
        if splitter not in ("ast", "langchain"):
            return {"error": messages.INVALID_SPLITTER.format(splitter=splitter)}
        try:
            full = checked_path(path)
        except InvalidPathError as problem:
            return {"error": str(problem)}
        before = self.running.get(full)  # a status left by a process that died doesn't block
        if self.book.is_indexing(full) and before is not None and not before.done():
            return {"error": messages.ALREADY_INDEXING.format(path=full)}
        incremental = not force and self.book.is_indexed(full) and self.store(full).exists()
        self._progress(full, 0)
        self.running[full] = self.pool.submit(self._index_safely, full, incremental, splitter, tuple(custom_extensions), tuple(ignore_patterns))
        notes = "" if path == full else messages.RESOLVED.format(given=path, path=full)
        for wording, own in ((messages.CUSTOM_EXTENSIONS, custom_extensions), (messages.CUSTOM_PATTERNS, ignore_patterns)):
            notes += wording.format(n=len(own), listed=", ".join(own)) if own else ""
        return {"message": messages.STARTED.format(path=full, splitter=splitter.upper(), notes=notes)}

    def wait(self, path: str, timeout: float | None = None) -> None:
        """Until a background run over ``path`` has ended."""
        if future := self.running.get(absolute(path)):
            future.result(timeout)

    def _progress(self, path: str, percentage: int) -> None:
        self.book.set_indexing(path, percentage)
        self.book.save()

    def _index_safely(self, path: str, incremental: bool, splitter: str, custom, ignored) -> None:
        try:
            self.spark.sparkContext.setJobGroup(f"index {path}", f"Index {path}", interruptOnCancel=True)
            self.index(path, incremental, splitter, custom, ignored)
        except Exception as problem:  # the status must say so, whatever it was
            self.book.set_failed(path, str(problem)[:2000], self.book.progress(path))
            self.book.save()

    def index(self, path: str, incremental: bool = False, splitter: str = "ast", custom=(), ignored=()) -> dict[str, int]:
        """Bring the store of ``path`` up to date, as one new generation of data and file hashes."""
        store, own = self.store(path), self.config.indexing
        files = scan.scan(
            self.spark, path, own.max_file_bytes, extensions=own.extensions, custom_extensions=custom, ignore_patterns=[*own.ignore_patterns, *ignored], hidden=own.include_hidden
        ).persist()
        held = [files]
        try:
            n_files = files.count()
            self._progress(path, 10)
            hashes, changed, replaced = sync.file_hashes(files), files, None
            if incremental:
                changes = sync.diff(store.read("file_hashes"), hashes).persist()
                held.append(changes)
                if changes.isEmpty():
                    n_chunks = store.read("chunks").count()
                    self._done(path, n_files, n_chunks, own.max_chunks)
                    return {"files": n_files, "chunks": n_chunks}
                replaced, there = changes.select("relative_path"), changes.filter("change <> 'removed'").select("relative_path")
                changed, hashes = (df.join(there, "relative_path", "left_semi") for df in (files, hashes))
            chunks = self.capped(chunking.chunk_files(changed, own.chunk_size, own.chunk_overlap, splitter, own.max_file_bytes)).persist()
            held.append(chunks)
            self._progress(path, 30)
            vectors = vector.guarded(chunks.select("id", embedding(self.embedder, F.col("content"), self.config.embedding.batch_size).alias("vector")), self.dimension).persist()
            held.append(vectors)  # an embedding is asked for once
            texts = chunks.select("id", "content")
            made = {"chunks": chunks, "vectors": vectors, "postings": bm25.postings(texts), "doc_len": bm25.document_lengths(texts), "signatures": vector.signature_rows(vectors, self.dimension), "file_hashes": hashes}
            self._progress(path, 60)
            store.commit(made, replaced)
            if store.due():
                store.compact()
            n_chunks = store.read("chunks").count()
            self._done(path, n_files, n_chunks, own.max_chunks)
            return {"files": n_files, "chunks": n_chunks}
        finally:
            for df in held:
                df.unpersist()

    def capped(self, chunks: DataFrame) -> DataFrame:
        """Chunks of the files, in path order, that start below the cap."""
        counts = chunks.groupBy(F.col("relative_path").alias("path")).agg(F.count("*").alias("n"))
        inside = chunking.within_cap(counts, self.config.indexing.max_chunks).select(F.col("path").alias("relative_path"))
        return chunks.join(inside, "relative_path", "left_semi").select(chunks.columns)

    def _done(self, path: str, files: int, chunks: int, cap: int) -> None:
        self.book.set_indexed(path, files, chunks, "limit_reached" if chunks >= cap else "completed")
        self.book.save()

    # -- find_code -----------------------------------------------------------

    def results(self, path: str, query: str, limit: int, extensions=(), query_language: bool = True) -> DataFrame:
        """The hybrid search: both legs' candidates are fused and ranked, and what they name is looked up, filtered and cut.

        The fused rows are at most two legs' candidates; their ids are pushed into the scan of the chunks, which lie in order of id.
        """
        own, store = self.config.search, self.store(path)
        chunks = store.read("chunks")
        values = embed_texts(self.embedder, [query])[0]
        vectors = store.read("vectors")
        if own.approximate:
            vectors = vectors.join(vector.lsh_candidates(store.read("signatures"), values, self.dimension), "id", "left_semi")
        by_vector = vector.top(vectors, vector.query_vector(values), own.candidates)
        texts = chunks.select("id", "content", "file_path")
        if query_language:
            by_text = bm25.Searcher(texts, store.read("postings"), store.read("doc_len")).search(query, own.candidates)
        else:
            by_text = bm25.top(bm25.scores(texts, bm25.query_terms(query)), own.candidates)
        placed = fusion.with_rank(fusion.fuse([by_vector, by_text], own.rrf_k), 2 * own.candidates)
        named = placed.select("id", "score", "rank").collect()
        table = self.spark.createDataFrame(named, "id string, score double, rank long")
        return fusion.lookup(table, chunks.filter(F.col("id").isin([r["id"] for r in named])), extensions, limit, own.min_score)

    def find_code(self, path: str, query: str, limit: int | None = None, extension_filter=()) -> dict:
        """Chunks for a query, best first, as text."""
        own = self.config.search
        limit = min(own.default_limit if limit is None else limit, own.max_limit)
        try:
            full = checked_path(path)
        except InvalidPathError as problem:
            return {"error": str(problem)}
        indexing = self.book.is_indexing(full)
        if not indexing and not self.book.is_indexed(full):
            return {"error": messages.NOT_INDEXED.format(path=full)}
        for ext in extension_filter:
            if not ext.startswith(".") or len(ext) <= 1 or " " in ext:
                return {"error": messages.INVALID_EXTENSION.format(ext=ext)}
        try:
            found = self.results(full, query, limit, extension_filter)
            rows = fusion.result_text(found, posixpath.basename(full) or "unknown", own.snippet_bytes).orderBy("display_rank").collect()
        except EngineError as problem:
            return {"error": str(problem)}
        if not rows:
            return {"message": messages.NO_RESULTS.format(query=query, path=full) + (messages.NO_RESULTS_YET if indexing else "")}
        body = "\n".join(r["text"] for r in rows)
        busy, tip = (messages.BUSY, messages.TIP) if indexing else ("", "")
        return {"message": messages.FOUND.format(n=len(rows), query=query, path=full, busy=busy, body=body, tip=tip), "results_count": len(rows)}

    # -- delete_index, check_status ------------------------------------------

    def delete_index(self, path: str) -> dict:
        """Drop the store of ``path`` and forget its status."""
        if not self.book.paths("indexed") and not self.book.paths("indexing"):
            return {"message": messages.NOTHING_INDEXED}
        try:
            full = checked_path(path)
        except InvalidPathError as problem:
            return {"error": str(problem)}
        if self.book.status(full) not in ("indexed", "indexing"):
            return {"error": messages.NOT_KNOWN.format(path=full)}
        self.store(full).drop()
        self.stores.pop(full, None)
        self.book.remove(full)
        self.book.save()
        indexed, indexing = len(self.book.paths("indexed")), len(self.book.paths("indexing"))
        text = messages.CLEARED.format(path=full)
        if indexed or indexing:
            text += messages.REMAINING.format(indexed=indexed, indexing=indexing)
        return {"message": text, "remaining_indexed": indexed, "remaining_indexing": indexing}

    def check_status(self, path: str) -> dict:
        try:
            full = checked_path(path)
        except InvalidPathError as problem:
            return {"error": str(problem)}
        return {"message": status.message(full, self.book.get(full))}


def as_json(answer: dict) -> str:
    """An answer as it goes over a wire."""
    return json.dumps(answer, ensure_ascii=False)
