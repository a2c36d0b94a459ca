"""Scanner, store, status, embedders and the four tools, end to end on small folders."""

import json
import os
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tessera.config import Config, EmbeddingConfig, IndexingConfig
from tessera.engine import Engine, as_json
from tessera.errors import ConfigError, EmbeddingError, StatusError
from tessera.operators import chunking
from tessera.sources import embedding, scan, status
from tessera.sources.status import StatusBook
from tessera.sources.store import Store


def put(root, name, content):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    return path


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "code")
    put(root, "_x.py", "a = 1\n")
    put(root, ".x.py", "hidden\n")
    put(root, ".d/x.py", "hidden\n")
    put(root, "Makefile", "all:\n")
    put(root, "A.PY", "upper\n")
    put(root, "bad.py", b"\xff\xfe\x00")
    put(root, "big.py", "x" * 1_000_001)
    put(root, "deep/er/y.rs", "fn parse_header() { }\n")
    put(root, "deep/skip/z.rs", "fn z() { }\n")
    put(root, "deep/.ignore", "skip/\n")
    put(root, "logs/a.txt", "log\n")
    put(root, "logs/keep.txt", "kept\n")
    put(root, ".ignore", "logs/*\n!logs/keep.txt\n")
    put(root, "custom.foo", "custom\n")
    os.symlink(os.path.join(root, "_x.py"), os.path.join(root, "link.py"))
    return root


def test_scan(spark, tree):
    names = lambda **o: sorted(os.path.relpath(p, tree) for p in scan.list_files(tree, **o))
    assert names() == ["_x.py", "bad.py", "big.py", "deep/er/y.rs", "logs/keep.txt"]
    assert "custom.foo" in names(custom_extensions=["foo"]) and ".x.py" in names(hidden=True) and ".d/x.py" in names(hidden=True)
    assert names(ignore_patterns=["deep", "*.txt"]) == ["_x.py", "bad.py", "big.py"]
    rows = {r["relative_path"]: r for r in scan.scan(spark, tree).collect()}
    assert set(rows) == {"_x.py", "big.py", "deep/er/y.rs", "logs/keep.txt"}  # what is no UTF-8 is skipped
    assert rows["deep/er/y.rs"]["language"] == "rust" and rows["_x.py"]["n_bytes"] == 6
    scan.register(spark)
    assert spark.read.format("codebase").load(tree).count() == 4
    chunks = chunking.chunk_files(scan.scan(spark, tree)).collect()
    assert "big.py" not in {c["relative_path"] for c in chunks}


def test_gitignore_counts_in_repositories_only(tmp_path):
    root = str(tmp_path / "r")
    put(root, ".gitignore", "/a.py\nsub/**/c.py\n[xy].py\n# note\n")
    for name in ("a.py", "sub/a.py", "sub/p/q/c.py", "x.py", "z.py"):
        put(root, name, "1")
    names = lambda: sorted(os.path.relpath(p, root) for p in scan.list_files(root))
    assert len(names()) == 5
    subprocess.run(["git", "init", "-q", root], check=True)
    assert names() == ["sub/a.py", "z.py"]


def test_store_generations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "data"), "/some/code")
    assert not store.exists() and store.read("chunks").count() == 0 and not store.has_rows("vectors")
    rows = lambda *ids: spark.createDataFrame([(i, [1.0, 2.0]) for i in ids], "id string, vector array<float>")
    store.commit({"vectors": rows("a")})
    opened = store.read("vectors")
    for ids in ("ab", "abc", "abcd"):
        store.commit({"vectors": rows(*ids)})
        if ids == "ab":
            assert opened.count() == 1  # readers keep the generation they opened
    assert store.current == 4 and store.counts()["vectors"] == 4
    assert sorted(e for e in os.listdir(store.folder) if e.startswith("gen=")) == ["gen=3", "gen=4"]
    store.drop()
    assert not store.exists() and os.path.isdir(tmp_path / "data")


def test_status_book(tmp_path):
    path = str(tmp_path / "s" / "snapshot.json")
    book, here = StatusBook(path), str(tmp_path)
    book.set_indexing(here, 50)
    assert book.is_indexing(here) and book.progress(here) == 50 and "50.0%" in status.message(here, book.get(here))
    book.set_indexed(here, 100, 500)
    book.set_failed(str(tmp_path / "gone"), "no", 30)
    book.save()
    with open(path) as f:
        saved = json.load(f)
    assert saved["formatVersion"] == "v2" and saved["codebases"][here]["indexedFiles"] == 100 and saved["codebases"][here]["totalChunks"] == 500
    again = StatusBook(path)
    assert again.is_indexed(here) and again.status(str(tmp_path / "gone")) == "not_found" and again.paths("indexed") == [here]
    again.remove(here)
    assert again.get(here) is None and "not indexed" in status.message(here, None)
    failed = {"status": "indexfailed", "errorMessage": "why", "lastAttemptedPercentage": 30, "lastUpdated": "2024-01-02T03:04:05+00:00"}
    assert "why" in status.message("/x", failed) and "30.0%" in status.message("/x", failed) and "2024-01-02 03:04:05" in status.message("/x", failed)
    assert status.epoch("1970-01-01T00:01:00+00:00") == 60 and status.epoch("never") == 0 and status.shown_time("never") == "unknown"
    put(str(tmp_path), "bad.json", "{")
    with pytest.raises(StatusError):
        StatusBook(str(tmp_path / "bad.json"))


class Service(BaseHTTPRequestHandler):
    calls: list = []
    fail_first = 0

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.calls.append((self.path, body, self.headers.get("Authorization")))
        if Service.fail_first > 0:
            Service.fail_first -= 1
            self.send_response(500)
            self.end_headers()
            return
        vectors = [[float(len(t)), 1.0] for t in body["input"]]
        if self.path.endswith("/embeddings"):
            answer = {"data": [{"index": k, "embedding": v} for k, v in reversed(list(enumerate(vectors)))]}
        else:
            answer = {"embeddings": vectors}
        raw = json.dumps(answer).encode()
        self.send_response(401 if "bad" in body["model"] else 200)
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.calls.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_embedding_services(service, monkeypatch):
    monkeypatch.setattr(embedding.time, "sleep", lambda _: None)
    openai = embedding.make_embedder(EmbeddingConfig("openai", "key", "m", f"{service}/v1"))
    assert embedding.embed_texts(openai, ["abc", ""]) == [[3.0, 1.0], [1.0, 1.0]]  # nothing is sent as a space
    path, body, auth = Service.calls[-1]
    assert path == "/v1/embeddings" and body == {"model": "m", "input": ["abc", " "], "encoding_format": "float"} and auth == "Bearer key"
    ollama = embedding.make_embedder(EmbeddingConfig("ollama", None, "nomic-embed-text:latest", service))
    Service.fail_first = 1
    assert embedding.dimension(ollama) == 2 and Service.calls[-1][:2] == ("/api/embed", {"model": "nomic-embed-text:latest", "input": ["test"]})
    assert ollama.max_tokens == 8192 and embedding.OllamaEmbedder("other").max_tokens == 2048
    with pytest.raises(EmbeddingError):
        embedding.embed_texts(embedding.OpenAIEmbedder("k", "bad", service), ["x"])
    with pytest.raises(ConfigError):
        embedding.make_embedder(EmbeddingConfig("openai"))
    assert embedding.prepared("é" * 9000, 2048) == "é" * 8192 and embedding.prepared("a" * 8192, 2048) == "a" * 8192


def test_config(tmp_path):
    env_file = put(str(tmp_path), ".env", "# c\nCHUNK_SIZE=77\nexport RRF_K='60'\nDATA_DIR=/x\n")
    got = Config.from_env({"DATA_DIR": "/y", "EMBEDDING_PROVIDER": "OLLAMA", "MIN_SCORE": "0.3"}, env_file)
    assert (got.data_dir, got.embedding.provider, got.search.rrf_k, got.indexing.chunk_size, got.search.min_score) == ("/y", "ollama", 60, 77, 0.3)
    assert Config.from_env({}, "/none").indexing.chunk_overlap == 200 and Config.from_env({"EMBEDDING_PROVIDER": "x"}, "/none").embedding.provider == "openai"


@pytest.fixture
def engine(spark, tmp_path):
    config = Config(data_dir=str(tmp_path / "data"), embedding=EmbeddingConfig("hashing", dimension=64), indexing=IndexingConfig(chunk_size=300, chunk_overlap=20))
    return Engine(spark, config)


def test_tools(engine, tree):
    assert "not indexed" in engine.find_code(tree, "x")["error"] and "not indexed" in engine.check_status(tree)["message"]
    assert "No codebases" in engine.delete_index(tree)["message"]
    assert "Invalid splitter" in engine.analyze_code(tree, splitter="x")["error"] and "does not exist" in engine.analyze_code(tree + "/none")["error"]
    assert "not a directory" in engine.check_status(os.path.join(tree, "_x.py"))["error"]
    started = engine.analyze_code(tree, custom_extensions=["foo"], ignore_patterns=["none"])
    assert "Started background indexing" in started["message"] and "custom extensions: foo" in started["message"]
    engine.wait(tree, 120)
    assert "5 files" in engine.check_status(tree)["message"] and "completed" in engine.check_status(tree)["message"]
    store = engine.store(tree)
    counts = store.counts()
    assert counts["chunks"] == counts["vectors"] == counts["doc_len"] == 4 and counts["file_hashes"] == 5
    found = engine.find_code(tree, "parse_header", limit=2)
    assert found["results_count"] == 2 and found["message"].index("deep/er/y.rs:1-1") > 0 and "1. Code snippet (rust) [code]" in found["message"]
    only = engine.find_code(tree, "a", extension_filter=[".py"])
    assert only["results_count"] == 1 and "_x.py" in only["message"]
    assert "Invalid file extension" in engine.find_code(tree, "a", extension_filter=["py"])["error"]
    assert "unknown field" in engine.find_code(tree, "std::vec")["error"] or "can't read" in engine.find_code(tree, "std::vec")["error"]
    assert "No results" in engine.find_code(tree, "a", extension_filter=[".zz"])["message"]
    assert json.loads(as_json(found))["results_count"] == 2
    # what has changed, and only that, is indexed anew
    before = store.current
    engine.index(tree, incremental=True, custom=("foo",))
    assert store.current == before
    put(tree, "deep/er/y.rs", "fn other_name() { }\n")
    put(tree, "new.md", "# Fresh heading\n")
    os.remove(os.path.join(tree, "custom.foo"))
    engine.analyze_code(tree, custom_extensions=["foo"])
    engine.wait(tree, 120)
    paths = {r["relative_path"] for r in store.read("chunks").collect()}
    assert paths == {"_x.py", "deep/er/y.rs", "logs/keep.txt", "new.md"} and store.current == before + 1
    assert "other_name" in engine.find_code(tree, "other_name", 1)["message"]
    assert store.counts()["vectors"] == store.counts()["chunks"] and store.read("postings").filter("term = 'parse'").count() == 0
    gone = engine.delete_index(tree)
    assert "Successfully cleared" in gone["message"] and gone["remaining_indexed"] == 0 and not store.exists()


def test_failures_are_recorded(engine, tree, monkeypatch):
    monkeypatch.setattr(engine, "index", lambda *_: (_ for _ in ()).throw(RuntimeError("broken service")))
    engine.analyze_code(tree)
    engine.wait(tree, 60)
    assert engine.book.status(tree) == "indexfailed" and "broken service" in engine.check_status(tree)["message"]
    monkeypatch.undo()
    engine.analyze_code(tree, force=True)
    engine.wait(tree, 120)
    assert engine.book.is_indexed(tree)


def test_chunk_cap(spark, tmp_path, tree):
    config = Config(data_dir=str(tmp_path / "d"), embedding=EmbeddingConfig("hashing"), indexing=IndexingConfig(max_chunks=2))
    engine = Engine(spark, config)
    engine.analyze_code(tree)
    engine.wait(tree, 120)
    assert engine.book.get(tree)["indexStatus"] == "limit_reached" and engine.book.get(tree)["totalChunks"] == 2


def test_stream(spark, tmp_path):
    from tessera.streaming.ingest import keep_current

    rows = [("/a.txt", "a.txt", ".txt", "unknown", "old", 1), ("/a.txt", "a.txt", ".txt", "unknown", "new text", 2)]
    kind = "path string, relative_path string, ext string, language string, content string, version int"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    keep_current(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["new text"]


def test_streams_upsert_by_file(spark, tmp_path):
    """Three batches: a file is new, changed, and gone; what holds now has its last version only."""
    from tessera.streaming.ingest import compact, current, keep_current

    kind = "path string, relative_path string, ext string, language string, content string, version int"
    row = lambda name, content, version: (f"/{name}", name, ".txt", "unknown", content, version)
    steps = [[row("a.txt", "first", 1), row("b.txt", "stays", 1), row("c.txt", "goes", 1)], [row("a.txt", "second", 2)], [row("c.txt", None, 3), row("d.txt", "late", 3)]]
    seen = []
    for rows in steps:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        keep_current(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        seen.append(sorted(r["content"] for r in current(spark, str(tmp_path / "out")).collect()))
    assert seen == [["first", "goes", "stays"], ["goes", "second", "stays"], ["late", "second", "stays"]]
    compact(spark, str(tmp_path / "out"), str(tmp_path / "whole"))
    assert spark.read.parquet(str(tmp_path / "whole")).count() == 3


def test_workers_walk_what_the_driver_would(spark, tmp_path, monkeypatch):
    """However few folders the driver leaves to the workers, the same files are found, by the same ignore rules."""
    for k in range(5):
        for j in range(3):
            put(str(tmp_path), f"d{k}/e{j}/f.py", f"x = {k}{j}\n")
            put(str(tmp_path), f"d{k}/e{j}/skip.py", "y = 0\n")
        put(str(tmp_path), f"d{k}/.ignore", "skip.py\n" if k % 2 else "e1/\n")
    whole = scan.list_files(str(tmp_path))
    assert len(whole) == 2 * 3 + 3 * 4
    for least in (1, 3, 8, 1000):
        monkeypatch.setattr(scan, "FOLDERS", least)
        assert sorted(r["path"] for r in scan.paths_below(spark, str(tmp_path)).collect()) == whole
        assert sorted(r["path"] for r in scan.scan(spark, str(tmp_path)).select("path").collect()) == whole


def test_approximate_search_reads_the_stored_index(spark, tmp_path, tree):
    """The engine finds by near buckets what it finds by all vectors, and keeps the index in step with changes."""
    from dataclasses import replace

    config = Config(data_dir=str(tmp_path / "data"), embedding=EmbeddingConfig(provider="hashing", dimension=32))
    exact = Engine(spark, config)
    exact.index(tree)
    near = Engine(spark, replace(config, search=replace(config.search, approximate=True)))
    ids = lambda engine: [r["relative_path"] for r in engine.results(tree, "fn parse_header", 5).orderBy("rank").collect()]
    assert ids(near)[0] == ids(exact)[0] == "deep/er/y.rs"
    put(tree, "deep/er/new.rs", "fn brand_new_name() { }\n")
    near.index(tree, incremental=True)
    signed = {r["id"] for r in near.store(tree).read("signatures").select("id").distinct().collect()}
    assert signed == {r["id"] for r in near.store(tree).read("vectors").select("id").collect()}
    assert near.results(tree, "brand_new_name", 5).orderBy("rank").first()["relative_path"] == "deep/er/new.rs"
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_a_sync_writes_what_has_changed(spark, tmp_path):
    """A sync adds a small layer, the tables read are those of a new index, and compaction changes no row."""
    root = str(tmp_path / "code")
    for k in range(40):
        put(root, f"m{k}.py", f"def name_{k}():\n    return {k}\n")
    config = lambda name: Config(data_dir=str(tmp_path / name), embedding=EmbeddingConfig(provider="hashing", dimension=16))
    engine = Engine(spark, config("data"))
    engine.index(root)
    put(root, "m3.py", "def renamed():\n    return 3\n")
    engine.index(root, incremental=True)
    store = engine.store(root)
    opened, files = store.read("chunks"), lambda g: {p: p.stat().st_mtime_ns for p in (tmp_path / "data").rglob(f"gen={g}/**/*.parquet")}
    base = files(1)
    assert [layer["gen"] for layer in store.layers()] == [1, 2] and opened.count() == 40
    os.remove(os.path.join(root, "m5.py"))
    put(root, "m41.py", "x = 1\n")
    put(root, "m3.py", "def name_3():\n    return 3\n")  # as it was first
    engine.index(root, incremental=True)
    engine.index(root, incremental=True)  # nothing has changed
    assert store.current == 3 and files(1) == base and opened.count() == 40
    fresh = Engine(spark, config("other"))
    fresh.index(root)
    tables = ("chunks", "vectors", "postings", "doc_len", "signatures", "file_hashes")
    rows = lambda of: {name: sorted(map(str, of.store(root).read(name).collect())) for name in tables}
    assert rows(engine) == rows(fresh)
    assert not store.due() and store.compact() == 4
    assert rows(engine) == rows(fresh) and [layer["gen"] for layer in store.layers()] == [4]
    engine.index(root)
    engine.index(root)
    assert sorted(x for x in os.listdir(store.folder) if x.startswith("gen=")) == ["gen=5", "gen=6"]
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_fifty_files_of_many_write_little(spark, tmp_path):
    """50 changed files of 20,000: the layer they add has under 1 % of the index's bytes, and the base stays as it is."""
    from pyspark.sql import functions as F

    store = Store(spark, str(tmp_path / "data"), "/code")
    text = lambda k, salt: F.concat_ws(" ", *[F.substring(F.sha2(F.concat(k.cast("string"), F.lit(f"{salt}-{j}")), 256), 1, 9) for j in range(60)])

    def tables(ids, salt):
        from tessera.operators import bm25, vector

        rows = ids.select(F.format_string("src/f%06d.txt", "id").alias("relative_path"), text(F.col("id"), salt).alias("content"))
        rows = rows.withColumn("id", F.sha2(F.concat("relative_path", F.lit(salt)), 256))
        chunks = rows.select("id", "content", F.col("relative_path").alias("file_path"), "relative_path", F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"),
            F.lit("unknown").alias("language"), F.struct(F.lit("txt").alias("file_extension"), F.lit(0).cast("long").alias("chunk_index"), F.lit("").alias("hash")).alias("metadata"), F.lit(0).cast("long").alias("ord"))
        vectors = rows.select("id", F.array(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000).cast("float") for k in range(16)]).alias("vector"))
        return {"chunks": chunks, "vectors": vectors, "postings": bm25.postings(rows), "doc_len": bm25.document_lengths(rows), "signatures": vector.signature_rows(vectors, 16), "file_hashes": rows.select("relative_path", F.sha2("content", 256).alias("hash"))}

    store.commit(tables(spark.range(20_000), "a"))
    changed = tables(spark.range(0, 20_000, 400), "b")
    store.commit(changed, changed["chunks"].select("relative_path"))
    base, delta = store.layers()
    every = [*delta["tables"], *base["tables"]]
    assert store.size([delta], every) < 0.01 * store.size([base], every)
    assert store.counts() == {"chunks": 20_000, "vectors": 20_000, "doc_len": 20_000, "file_hashes": 20_000}
    assert store.read("postings").filter("id IS NOT NULL").select("id").distinct().count() == 20_000
    assert len([p for p in (tmp_path / "data").rglob("gen=2/*/*.parquet")]) < 40


def test_two_writers_do_not_meet(spark, tmp_path, monkeypatch):
    from tessera.errors import EngineError

    store = Store(spark, str(tmp_path / "data"), "/code")
    rows = lambda i: spark.createDataFrame([(i, [1.0])], "id string, vector array<float>")
    store.commit({"vectors": rows("a")})
    claimed = store._claim()
    assert store.commit({"vectors": rows("b")}) == claimed + 1
    with pytest.raises(EngineError, match="another run"):
        store._publish(claimed, 1, [{"gen": claimed, "tables": []}])
    assert [r["id"] for r in store.read("vectors").collect()] == ["b"]
