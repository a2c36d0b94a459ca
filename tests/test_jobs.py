"""The two jobs: reruns, growing input, command lines."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import build_index, ingest_chunks, queries, settings
from tessera.operators import blockmax, bm25

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, lang string, source string, version int"


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_sql_agrees(spark, name):
    settings_now = lambda: rows_of(spark.sql("SET").filter("key LIKE 'spark.sql%'"))
    before = settings_now()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.select(columns)) == sorted(map(repr, found.fetchall()))
    assert settings_now() == before and not spark.streams.active


def test_index_is_replaced_and_searched(spark, tmp_path):
    source, target = str(tmp_path / "docs"), str(tmp_path / "index")
    spark.createDataFrame([(1, "one two two"), (2, "two three"), (3, None), (4, ""), (None, "two")], "doc_id long, text string").write.parquet(source)
    first = build_index.run(spark, source, target)
    assert first == {"documents": 4, "tokens": 5, "blocks": 4, "postings": 4}
    before = rows_of(build_index.read(spark, target))
    assert build_index.run(spark, source, target) == first and rows_of(build_index.read(spark, target)) == before
    spark.createDataFrame([(9, "four")], "doc_id long, text string").write.mode("overwrite").parquet(source)
    assert build_index.run(spark, source, target)["postings"] == 1
    found = blockmax.top(build_index.read(spark, target), spark.createDataFrame([(0, "four two")], "query_id int, text string"), 5)
    assert [(r["id"], r["rank"]) for r in found.collect()] == [(9, 1)]
    assert sorted(r["class"] for r in spark.read.parquet(f"{target}/documents").collect()) == ["01-"]


def test_index_partitions_are_folders(spark, tmp_path):
    build_index.run(spark, f"{FOLDER}/documents.parquet", str(tmp_path / "index"), buckets=4)
    assert {p.name for p in (tmp_path / "index/postings").iterdir() if p.is_dir()} == {f"bucket={k}" for k in range(4)}


def test_index_leaves_nothing_persisted(spark, tmp_path):
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    build_index.run(spark, f"{FOLDER}/documents.parquet", str(tmp_path / "index"))
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before


def grow(spark, path, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(path)


def test_ingest_takes_only_what_is_new(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "mark"))
    run = lambda: ingest_chunks.run(spark, source, target, checkpoint, version_column="version")
    now = lambda: sorted(r["content"] for r in ingest_chunks.read(spark, target).collect())
    grow(spark, source, [(1, "first", "en", "a", 1), (2, "stays", "fr", "a", 1), (3, "goes", "de", "b", 1)])
    assert run() == {"rows": 3, "batches": 1, "chunks": 3} and now() == ["first", "goes", "stays"]
    assert {p.name for p in (tmp_path / "out/batch=0").iterdir() if p.is_dir()} == {"language=markdown", "language=rust", "language=python"}
    written = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    grow(spark, source, [(1, "second", "en", "a", 2), (3, None, "de", "b", 2), (4, "new", "es", "c", 2)])
    assert run() == {"rows": 3, "batches": 1, "chunks": 2} and now() == ["new", "second", "stays"]
    assert all(Path(p).stat().st_mtime_ns == t for p, t in written.items())  # what was there is not written again
    assert run() == {"rows": 0, "batches": 0, "chunks": 0} and now() == ["new", "second", "stays"]
    grow(spark, source, [(1, "late", "en", "a", 1)])
    assert run()["rows"] == 1 and now() == ["new", "second", "stays"]


def test_a_batch_that_only_removes(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "mark"))
    grow(spark, source, [(1, None, "en", "a", 2)])
    assert ingest_chunks.run(spark, source, target, checkpoint, version_column="version") == {"rows": 1, "batches": 1, "chunks": 0}
    assert ingest_chunks.read(spark, target).count() == 0
    grow(spark, source, [(1, "late", "en", "a", 1), (2, "there", None, "b", 1)])
    assert ingest_chunks.run(spark, source, target, checkpoint, version_column="version")["rows"] == 2
    assert [r["content"] for r in ingest_chunks.read(spark, target).collect()] == ["there"]


def test_a_run_that_broke_off_is_taken_up(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "mark"))
    grow(spark, source, [(1, "first", "en", "a", 1), (2, "second", "fr", "a", 1)])
    ingest_chunks.run(spark, source, target, checkpoint)
    before = rows_of(ingest_chunks.read(spark, target).select("id", "content"))
    # as if it had ended after the batch was written and before it was marked as done
    (tmp_path / "mark/commits/0").unlink()
    (tmp_path / "mark/commits/.0.crc").unlink(missing_ok=True)
    assert ingest_chunks.run(spark, source, target, checkpoint)["rows"] == 2
    assert rows_of(ingest_chunks.read(spark, target).select("id", "content")) == before


def test_settings(tmp_path):
    file = tmp_path / "x.json"
    file.write_text(json.dumps({"size": 500}))
    assert settings.load(str(file), {"size": 1000, "overlap": 200}) == {"size": 500, "overlap": 200}
    file.write_text(json.dumps({"sizes": 500}))
    with pytest.raises(ValueError, match="sizes"):
        settings.load(str(file), {"size": 1000})
    for job, module in (("build_index", build_index), ("ingest_chunks", ingest_chunks)):
        assert settings.load(str(ROOT / f"jobs/{job}.json"), module.SETTINGS) == module.SETTINGS


@pytest.mark.parametrize("job, more", [("build_index", []), ("ingest_chunks", ["--checkpoint", "mark"])])
def test_command_lines(spark, tmp_path, job, more):
    command = [sys.executable, str(ROOT / f"jobs/{job}.py"), "--source", f"{FOLDER}/documents.parquet", "--target", str(tmp_path / "out"), *[str(tmp_path / m) if m == "mark" else m for m in more]]
    done = subprocess.run(command, capture_output=True, text=True, timeout=300, cwd=tmp_path, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=4 pyspark-shell"})
    assert done.returncode == 0, done.stderr[-3000:]
    assert "read 200 " in done.stderr and "wrote" in done.stderr and any((tmp_path / "out").rglob("*.parquet"))
    missing = subprocess.run(command[:2], capture_output=True, text=True, timeout=60)
    assert missing.returncode == 2 and "source" in missing.stderr


# -- block-max postings -------------------------------------------------------


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    import random

    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(60)], k=rng.choice([3, 9, 40, 200])))) for k in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "?!"), (5003, "w1 " * 30), (5004, "w1 " * 30)]
    asked = [(1, "w59 w58"), (2, "w0"), (3, "w1 w30 w1 unheard"), (4, "nothing here"), (5, ""), (6, None)]
    return spark.createDataFrame(rows, "id long, content string").repartition(4), spark.createDataFrame(asked, "query_id int, text string")


@pytest.mark.parametrize("block_docs, lead, k", [(8, 1, 3), (64, 4, 10), (10**6, 1, 2000)])
def test_blockmax_gives_what_scoring_everything_gives(spark, tmp_path, corpus, block_docs, lead, k):
    docs, asked = corpus
    blockmax.write(blockmax.build(docs, block_docs), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert ranked(blockmax.top(index, asked, k, lead)) == ranked(bm25.batch_scores(docs, asked, k))


def test_blocks_are_passed_over_and_bounds_hold(spark, tmp_path, corpus):
    docs, asked = corpus
    blockmax.write(blockmax.build(docs, 16), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    counts = {r["query_id"]: (r["blocks"], r["skipped"]) for r in blockmax.skipped(index, asked, 3, 2).collect()}
    assert set(counts) == {1, 2, 3} and sum(s for _, s in counts.values()) > sum(b for b, _ in counts.values()) / 4
    assert index.filter((F.size("ids") != F.col("docs")) | (F.array_max("parts") != F.col("top"))).count() == 0
    assert index.groupBy("block").agg(F.countDistinct(F.length("block"))).count() > 40
    plan = blockmax.bounds(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "parts" not in plan and "ids" not in plan


def test_index_is_the_same_whatever_counts_as_hot_and_postings_move_by_block_alone(spark, corpus):
    docs, _ = corpus
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select("bucket", "term", "block", "df", "docs", "top", "ids", "parts").collect())
    cold, hot = blockmax.build(docs, 16, hot_docs=10**9), blockmax.build(docs, 16, hot_docs=50)
    assert rows(cold) == rows(hot)
    plan = hot._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "hashpartitioning(block" in plan and "SortMergeJoin" not in plan


def index_rows(df):
    return sorted(tuple(map(str, r)) for r in df.select("bucket", "term", "block", "df", "docs", "top", "ids", "parts").collect())


@pytest.mark.parametrize("hot_docs", [50, 10**9])
def test_index_is_the_same_however_the_work_is_cut(spark, corpus, monkeypatch, hot_docs):
    docs, _ = corpus
    whole = index_rows(blockmax.build(docs, 16, hot_docs=hot_docs))
    monkeypatch.setattr(blockmax, "SET_TOKENS", 300)
    monkeypatch.setattr(blockmax, "SLICE_TOKENS", 200)
    monkeypatch.setattr(blockmax, "OUT_ROWS", 7)
    assert index_rows(blockmax.build(docs, 16, hot_docs=hot_docs)) == whole


def test_index_is_built_in_one_pass_over_each_exchange(spark, corpus):
    docs, _ = corpus
    plan = blockmax.build(docs, 16)._jdf.queryExecution().executedPlan().toString()
    # a range's bounds cost a run of all that is below it, and a lookup in a term's rows a sort of them
    assert "rangepartitioning" not in plan and "Window" not in plan and "ObjectHashAggregate" not in plan
    assert plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("kind, ids", [("long", [7, 1, None]), ("string", ["b", "ä", "a"])])
def test_index_of_odd_tables(spark, kind, ids):
    make = lambda texts: spark.createDataFrame(list(zip(ids, texts, strict=True)), f"id {kind}, content string").filter("id IS NOT NULL")
    for texts in ([None, None, None], ["", "?!", None]):
        assert blockmax.build(make(texts)).count() == 0
    assert blockmax.build(make(["a", "b", "c"]).limit(0)).count() == 0
    found = {r["term"]: r for r in blockmax.build(make(["Éa 1 1 𝔘x", None, None])).collect()}
    assert sorted(found) == ["1", "éa", "𝔘x"] and all(r["ids"] == [ids[0]] and r["df"] == 1 for r in found.values())
    both = {r["term"]: r["ids"] for r in blockmax.build(make(["x y", "x z", "x y"])).collect()}
    assert both["x"] == sorted(i for i in ids if i is not None)


def test_newest_versions_in_any_order(spark, tmp_path):
    from itertools import permutations

    from tessera.streaming.ingest import current, keep_current

    kind = "path string, relative_path string, ext string, language string, content string, version int"
    row = lambda content, version: ("/a.txt", "a.txt", ".txt", "unknown", content, version)
    batches, ends = [[row("old", 1), row("older", None)], [row("new", 2), row("new too", 2)], [row(None, 2), row("new", 2)]], set()
    for k, order in enumerate(permutations(batches)):
        base = tmp_path / str(k)
        for rows in order:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(base / "in"))
            keep_current(spark.readStream.schema(kind).parquet(str(base / "in")), str(base / "out"), str(base / "cp")).awaitTermination(60)
        ends.add(tuple(r["content"] for r in current(spark, str(base / "out")).collect()))
    assert len(ends) == 1 and next(iter(ends))[0].startswith("new")
