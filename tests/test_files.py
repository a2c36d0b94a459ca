"""Code and stores by URI: ``file:`` for code, ``file:`` and a view file system, which ``os`` can't open, for data."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tessera.config import Config, EmbeddingConfig, IndexingConfig
from tessera.engine import Engine
from tessera.errors import EngineError
from tessera.sources import files, scan, status
from tessera.sources.files import Hadoop, Local
from tessera.sources.status import StatusBook
from tessera.sources.store import Store


def put(root, name, content):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(content)
    return path


@pytest.fixture
def code(tmp_path):
    """A folder with ignore files, links and names that a URI would encode."""
    root = str(tmp_path / "my code")
    for name in ("_x.py", "a b.py", "50%25.py", "ü#?.py", "deep/er/y.rs", "deep/skip/z.rs", "logs/keep.txt", "logs/a.txt", "sub/p/c.py"):
        put(root, name, f"fn {os.path.basename(name)[0]}() {{ }}\n")
    put(root, "deep/.ignore", "skip/\n")
    put(root, ".ignore", "logs/*\n!logs/keep.txt\n")
    put(root, ".gitignore", "/sub/**/c.py\n")
    put(root, ".git/info/exclude", "")
    os.symlink(os.path.join(root, "_x.py"), os.path.join(root, "link.py"))
    os.symlink(root, os.path.join(root, "deep", "loop"))
    return root


@pytest.fixture(params=["file", "viewfs"])
def data(request, spark, tmp_path):
    """The URI of an empty data folder."""
    (tmp_path / "held").mkdir()
    if request.param == "file":
        return f"file://{tmp_path}/held/data"
    mount = f"m{abs(hash(str(tmp_path)))}"
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{mount}.link./in", f"file://{tmp_path}/held")
    return f"viewfs://{mount}/in/data"


def test_names_of_places():
    assert files.absolute("file:/a/./b//c/") == "file:///a/b/c" and files.absolute("hdfs://n:8020/a/../b") == "hdfs://n:8020/b"
    assert files.absolute("S3A://bucket") == "s3a://bucket/" and files.absolute("/a//b/../c/") == "/a/c" and files.absolute("~") == os.path.expanduser("~")
    assert files.split("c:/x") == ("", "c:/x") and files.split("a:b") == ("", "a:b") and files.split("") == ("", "")
    assert files.parent("file:///a/b") == "file:///a" and files.parent("file:///") == "file:///" and files.parent("/a/b") == "/a"


def test_a_uri_lists_what_a_path_lists(spark, code, monkeypatch):
    uri = files.absolute(f"file:{code}")
    below = lambda paths, root: sorted(p.removeprefix(root + "/") for p in paths)
    expected = ["50%25.py", "_x.py", "a b.py", "deep/er/y.rs", "logs/keep.txt", "ü#?.py"]
    for options in ({}, {"hidden": True}, {"ignore_patterns": ["deep", "a b*"]}, {"custom_extensions": ["foo"]}):
        assert below(scan.list_files(uri, **options), uri) == below(scan.list_files(code, **options), code)
    assert below(scan.list_files(uri), uri) == expected
    columns = ("relative_path", "ext", "language", "content", "n_bytes", "hash")
    for folders in (1, 256):  # walked by the workers, and by the driver
        monkeypatch.setattr(scan, "FOLDERS", folders)
        assert sorted(scan.scan(spark, uri).select(*columns).collect()) == sorted(scan.scan(spark, code).select(*columns).collect())
    assert [r["n_bytes"] for r in scan.scan(spark, uri, max_bytes=3).filter("content IS NULL").collect()] != []
    scan.register(spark)
    assert below((r["path"] for r in spark.read.format("codebase").load(uri).collect()), uri) == expected


def test_what_cannot_be_opened(tmp_path):
    assert files.kind(f"file://{tmp_path}/none") is None and files.kind(f"file://{tmp_path}") == "dir"
    with pytest.raises(OSError):
        files.entries(f"file://{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        files.size(f"file://{tmp_path}")
    with pytest.raises(ValueError):
        files.kind("nosuch://x/y")


def test_small_files(spark, data, tmp_path):
    """Reading, replacing, claiming, measuring and removing, on either file system."""
    place = Hadoop(spark)
    with pytest.raises(FileNotFoundError):
        place.read(f"{data}/s/one")
    for content in (b"first", b"", bytes(range(256)), b"last"):
        place.replace(f"{data}/s/one", content)
        assert place.read(f"{data}/s/one") == content
    assert place.names(f"{data}/s") == ["one"] and place.bytes_below(data) == 4 and place.bytes_below(f"{data}/none") == 0
    won = []
    callers = [threading.Thread(target=lambda: won.append(place.claim(f"{data}/g/gen=1"))) for _ in range(8)]
    for caller in callers:
        caller.start()
    for caller in callers:
        caller.join()
    assert sorted(won) == [False] * 7 + [True]
    place.remove(f"{data}/g")
    place.remove(f"{data}/g")
    assert place.names(data) == ["s"] and place.claim(f"{data}/g/gen=1")
    local = Local()
    local.replace(str(tmp_path / "l" / "one"), b"x")
    assert local.read(str(tmp_path / "l" / "one")) == b"x" and os.listdir(tmp_path / "l") == ["one"]


def test_store(spark, data):
    store = Store(spark, data, "hdfs://far/code")
    assert not store.exists() and store.read("vectors").count() == 0 and store.layers() == []
    rows = lambda *ids: spark.createDataFrame([(i, [1.0, 2.0]) for i in ids], "id string, vector array<float>")
    for ids in ("a", "ab", "abc", "abcd"):
        store.commit({"vectors": rows(*ids)})
    assert store.current == 4 and store.counts()["vectors"] == 4 and store.size(store.layers()) > 0
    assert [n for n in store.files.names(store.folder) if n.startswith("gen=")] == ["gen=3", "gen=4"]
    claimed = store._claim()
    assert store.commit({"vectors": rows("e")}) == claimed + 1
    with pytest.raises(EngineError, match="another run"):
        store._publish(claimed, 4, [{"gen": claimed, "tables": []}])
    assert [r["id"] for r in store.read("vectors").collect()] == ["e"] and store.compact() == claimed + 2
    assert [r["id"] for r in Store(spark, data, "hdfs://far/code").read("vectors").collect()] == ["e"]
    store.drop()
    assert not store.exists() and store.files.names(data) == []


def test_tools(spark, code, data):
    """Index, search, sync, status and deletion with URIs for code and data."""
    uri, config = files.absolute(f"file:{code}"), Config(data_dir=data, embedding=EmbeddingConfig("hashing", dimension=64), indexing=IndexingConfig(chunk_size=300, chunk_overlap=20))
    engine = Engine(spark, config)
    assert "does not exist" in engine.analyze_code(uri + "/none")["error"] and "not a directory" in engine.check_status(uri + "/_x.py")["error"]
    assert "can't be read" in engine.find_code("nosuch://x/y", "a")["error"]
    engine.analyze_code(uri)
    engine.wait(uri, 120)
    assert "6 files" in engine.check_status(uri)["message"] and "completed" in engine.check_status(uri)["message"]
    put(code, "deep/er/y.rs", "fn other_name() { }\n")
    put(code, "new.md", "# Fresh heading\n")
    os.remove(os.path.join(code, "a b.py"))
    again = Engine(spark, config)  # status and pointer come from the files
    assert again.book.is_indexed(uri)
    again.index(uri, incremental=True)
    again.index(uri, incremental=True)
    store = again.store(uri)
    assert [layer["gen"] for layer in store.layers()] == [1, 2] and store.current == 2
    indexed = {r["relative_path"] for r in store.read("chunks").collect()}
    assert indexed == {"50%25.py", "_x.py", "deep/er/y.rs", "logs/keep.txt", "new.md", "ü#?.py"}
    assert store.read("chunks").filter(F.col("file_path").startswith("file:") | F.col("file_path").isin(*indexed)).count() == store.counts()["chunks"]
    found = again.find_code(uri, "other_name", 1)["message"]
    assert "deep/er/y.rs:1-1" in found and "my code" in found
    assert "Successfully cleared" in again.delete_index(uri)["message"] and not store.exists()


def test_status_stays_where_a_place_cannot_be_reached(spark, data, monkeypatch):
    book = StatusBook(f"{data}/snapshot.json", Hadoop(spark))
    for path in ("nosuch://x/y", "file:///surely/not/there"):
        book.set_indexed(path, 1, 2)
    book.save()
    again = StatusBook(f"{data}/snapshot.json", Hadoop(spark))
    assert again.paths("indexed") == ["nosuch://x/y"] and status.files.kind("file:///surely/not/there") is None
