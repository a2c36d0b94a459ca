"""Ranking, fusion, query language, paths and sync."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.errors import FullTextError
from tessera.functions import languages, paths
from tessera.operators import bm25, fusion, sync, vector


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- fusion ------------------------------------------------------------------


def test_fusion_mixed(spark):
    v = frame(spark, [("doc1", 0.9), ("doc2", 0.8), ("doc3", 0.7)], "id string, score double")
    b = frame(spark, [("doc2", 10.0), ("doc1", 9.0), ("doc4", 8.0)], "id string, score double")
    got = fusion.fused_top(fusion.fuse([v, b], 100), 10).collect()
    assert [r["id"] for r in got] == ["doc1", "doc2", "doc3", "doc4"]
    assert got[0]["score"] == got[1]["score"] == pytest.approx(1 / 101 + 1 / 102)
    swapped = fusion.fused_top(fusion.fuse([b, v], 100), 10).collect()
    assert [tuple(r) for r in swapped] == [tuple(r) for r in got]


def test_fusion_single(spark):
    one = frame(spark, [("doc1", 1.0)], "id string, score double")
    assert fusion.fuse([one, one], 100).first()["score"] == pytest.approx(2 / 101, abs=1e-3)


def test_lookup_keeps_gaps_and_filters_before_the_limit(spark):
    placed = frame(spark, [(k, 1.0 / k, k) for k in range(1, 9)], "id int, score double, rank long")
    chunks = frame(spark, [(k, f"/r/{k}{'.py' if k % 2 else '.rs'}") for k in range(1, 9) if k != 3] + [(50, "/r/noext")], "id int, file_path string")
    assert [r["rank"] for r in fusion.lookup(placed, chunks, limit=4).orderBy("rank").collect()] == [1, 2, 4, 5]
    assert [r["rank"] for r in fusion.lookup(placed, chunks, [".py"], limit=2).orderBy("rank").collect()] == [1, 5]
    assert [r["rank"] for r in fusion.lookup(placed, chunks, limit=9, least=0.3).orderBy("rank").collect()] == [1, 2]


def test_snippets_end_on_a_character(spark):
    for most in (9, 10, 11, 12):
        for text in ("é" * 20, "€" * 9, "\U0001f600" * 9, "a" * 30, "abc", ""):
            got = spark.range(1).select(fusion.snippet(F.lit(text), most).alias("s")).first()["s"]
            whole = text if len(text.encode()) <= most else text.encode()[:most].decode("utf-8", "ignore") + fusion.TRUNCATED
            assert got == whole


# -- vectors -----------------------------------------------------------------


def test_vector_search(spark):
    ones, unit = [1.0] * 128, [1.0] + [0.0] * 127
    rows = frame(spark, [("doc1", ones), ("doc2", unit)], "id string, vector array<float>")
    got = vector.top(rows, vector.query_vector(ones), 2).collect()
    assert [r["id"] for r in got] == ["doc1", "doc2"] and got[0]["score"] > got[1]["score"]
    with pytest.raises(Exception, match="expected a vector of 64"):
        vector.guarded(rows, 64).collect()


def test_lsh_recall(spark):
    import random

    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(10)]
    rows = frame(spark, [(k, [x + rng.gauss(0, 0.2) for x in centres[k % 10]]) for k in range(600)], "id long, vector array<float>")
    asked = rows.filter("id < 10").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    exact = {(r["query_id"], r["id"]) for r in vector.batch_top(rows, asked, 10).collect()}
    near = {(r["query_id"], r["id"]) for r in vector.lsh_top(rows, asked, 10, 16).collect()}
    assert len(exact & near) / len(exact) > 0.9


def test_batches_and_buckets_equal_single_pairs(spark, monkeypatch):
    import random

    rng = random.Random(5)
    some = [[1.0, *(float(rng.choice([-2, -1, 0, 1, 2])) for _ in range(3))] for _ in range(40)]
    odd = [None, [float("nan")] * 4, [1.0, None, 1.0, 1.0], [1.0, 2.0]]
    rows = frame(spark, list(enumerate(some + some + odd)), "id int, vector array<double>")
    asked = rows.filter("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    monkeypatch.setattr(vector, "SET_VECTORS", 16)
    monkeypatch.setattr(vector, "SET_QUERIES", 8)
    text = lambda df: sorted(map(str, df.collect()))
    pairs = rows.crossJoin(asked).select("query_id", "id", F.round(vector.cosine(F.col("vector"), F.col("query")), 6).alias("score"))
    placed = lambda df: df.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank").filter("rank <= 7").withColumn("rank", F.col("rank").cast("long"))
    assert text(vector.batch_top(rows, asked, 7)) == text(placed(pairs))
    model = vector.lsh_model(4, 2, 3)
    v, q = rows.withColumnRenamed("vector", "v"), asked.withColumnRenamed("query", "q")
    near = vector.lsh_top(rows, asked, 7, 4, model)
    assert text(near) == text(placed(vector._lsh_pairs(v, q, model)))
    assert "MapInArrow" in near._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_lsh_recall_on_the_embeddings(spark, folder):
    from tessera.plans.queries import QUERIES

    exact, near = ({(r["query_id"], r["id"]) for r in QUERIES[name](spark, f"/root/testdata/{folder}").collect() if r["query_id"] != r["id"]} for name in ("cosine_batch", "ann_lsh_topk"))
    assert len(exact & near) / len(exact) >= 0.9


# -- full text ---------------------------------------------------------------

DOCS = [
    (1, "the quick brown fox", "a.py"), (2, "the lazy dog and the quick cat", "b.py"), (3, "brown bread", "c.rs"), (4, "", "d.rs"),
    (5, "quick quick quick fox jumps", "e.py"), (6, "fox brown", "f.py"),
]


@pytest.fixture(scope="module")
def searcher(spark):
    return bm25.Searcher(frame(spark, DOCS, "id int, content string, file_path string"))


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("fox", {1, 5, 6}), ("fox bread", {1, 3, 5, 6}), ("fox AND brown", {1, 6}), ("fox AND brown OR dog", {1, 2, 6}), ("dog OR fox AND quick", {1, 2, 5}),
        ("+fox -brown", {5}), ("fox NOT quick", {6}), ('"brown fox"', {1}), ('"fox brown"', {6}), ('"quick fox"~1', {1, 5}), ("(fox OR dog) AND quick", {1, 2, 5}),
        ("content:bread", {3}), ("file_path:c.rs", {3}), ("id:5", {5}), ("[cat TO dog]", {2}), ("content:{cat TO dog}", set()), ("content:IN [bread dog]", {2, 3}), ("*", {1, 2, 3, 4, 5, 6}),
        ("fox^2 bread", {1, 3, 5, 6}), ("-fox", {2, 3, 4}), ("+fox dog", {1, 5, 6}), ("quick-brown", {1}), ("nothing", set()), ("QUICK", {1, 2, 5}),
    ],
)
def test_query_language(searcher, text, ids):
    assert {r["id"] for r in searcher.search(text, 50).collect()} == ids


@pytest.mark.parametrize("text", ["std::vec", "nofield:x", "(fox", "fox)", "AND fox", "fox AND", '"open'])
def test_query_errors(text):
    with pytest.raises(FullTextError):
        bm25.parse(text)


@given(st.text(alphabet='ab "()[]{}:^+-~*ANDORT ', max_size=30))
@settings(max_examples=500, deadline=None)
def test_parser_gives_a_tree_or_an_error(text):
    try:
        assert isinstance(bm25.parse(text), bm25.Node)
    except FullTextError:
        pass


def test_boost_and_frequency_order(searcher):
    assert searcher.search("quick", 1).first()["id"] == 5
    assert searcher.search("fox bread^9", 1).first()["id"] == 3


def test_one_pass_scores_equal_postings_scores(spark, searcher):
    docs = frame(spark, DOCS, "id int, content string, file_path string")
    fast = {r["id"]: r["score"] for r in bm25.scores(docs, ["fox", "quick"]).collect()}
    slow = {r["id"]: r["score"] for r in searcher.search("fox quick", 50).collect()}
    asked = frame(spark, [(1, "fox quick")], "query_id int, text string")
    batch = {r["id"]: r["score"] for r in bm25.batch_scores(docs, asked, 50).collect()}
    assert fast == pytest.approx(slow, abs=1e-5) and fast == pytest.approx(batch, abs=1e-5)
    assert bm25.scores(docs, []).count() == 0


# -- paths and languages -----------------------------------------------------


def test_globs(spark):
    import re

    match = lambda text, glob: bool(text and glob and re.fullmatch(paths.glob_regex(glob), text))
    assert match("test.js", "*.js") and match("test.min.js", "*.min.js") and not match("test.js", "*.ts") and match("node_modules", "node_modules")
    assert match("a/b/c.js", "a*.js") and not match("ab", "a?") and not match("", "*")


def test_ignored(spark):
    given_paths = ["node_modules", "src/node_modules", ".git", "test.log", "src/index.js", "build/x/y.js", "rebuild/y", "docs/a.md", "x/docs/a.md"]
    rows = frame(spark, [(p,) for p in given_paths], "p string")
    kept = {r["p"] for r in rows.filter(~paths.is_ignored(F.col("p"), ["node_modules", ".git", "*.log", "build/", "docs/a*"])).collect()}
    assert kept == {"src/index.js", "rebuild/y", "x/docs/a.md"}


def test_extensions_and_languages(spark):
    rows = frame(spark, [("/a/b.py",), ("/a/B.PY",), ("/a/.bashrc",), ("/a/Makefile",), ("/a/x.tar.gz",), ("/a.d/noext",), ("/a/.x.rs",), ("/a/t.tsx",), ("/a/s.less",)], "p string")
    ext = paths.file_extension(F.col("p"))
    got = {r["p"]: (r["e"], r["l"]) for r in rows.select("p", ext.alias("e"), languages.language_of(ext).alias("l")).collect()}
    assert got["/a/b.py"] == (".py", "python") and got["/a/B.PY"] == (".PY", "unknown") and got["/a/.bashrc"] == ("", "unknown")
    assert got["/a/Makefile"][0] == "" and got["/a/x.tar.gz"][0] == ".gz" and got["/a.d/noext"][0] == "" and got["/a/t.tsx"][1] == "typescript" and got["/a/s.less"][1] == "css"
    assert len(languages.DEFAULT_EXTENSIONS) == len(set(languages.DEFAULT_EXTENSIONS)) and set(languages.NODE_KINDS) == set(languages.EXTENSIONS)


# -- sync --------------------------------------------------------------------

hashes = st.dictionaries(st.sampled_from("abcdef"), st.sampled_from("xyz"), max_size=6)


@given(hashes, hashes)
@settings(max_examples=12, deadline=None)
def test_diff_and_apply(spark, a, b):
    old, new = (frame(spark, list(x.items()), "relative_path string, hash string") for x in (a, b))
    changes = sync.diff(old, new)
    expected = {(k, "removed") for k in a.keys() - b.keys()} | {(k, "added") for k in b.keys() - a.keys()} | {(k, "modified") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert {tuple(r) for r in changes.collect()} == expected
    assert {tuple(r) for r in sync.apply_changes(old, new, changes).collect()} == set(b.items())
    assert sync.diff(old, old).count() == 0


def test_merkle(spark):
    first = frame(spark, [("f1", "h1"), ("f2", "h2")], "relative_path string, hash string")
    second = frame(spark, [("f3", "h3"), ("f2", "changed"), ("f1", "h1")], "relative_path string, hash string")
    nodes = sync.merkle_nodes(first)
    top = sync.roots(nodes).first()["node"]
    assert sync.roots(nodes).count() == 1 and sync.leaves(nodes).count() == 2 and sync.children(nodes, top).count() == 2
    changes = {r["change"] for r in sync.compare_dags(sync.merkle_leaves(first), sync.merkle_leaves(second)).collect()}
    assert changes == {"added", "removed"}
    root = lambda x: sync.merkle_root(x).first()["root"]
    assert root(first) == root(first.orderBy(F.desc("hash"))) != root(second)


def test_upsert_delete_lookup(spark):
    old = frame(spark, [(1, "a"), (2, "b")], "id int, v string")
    new = frame(spark, [(2, "c"), (3, "d")], "id int, v string")
    assert {tuple(r) for r in sync.upsert(old, new).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in sync.delete(old, frame(spark, [(2,), (9,)], "id int")).collect()} == {(1, "a")}
    wanted = frame(spark, [(0, 2), (1, 7)], "ordinal int, id int")
    assert [(r["ordinal"], r["v"]) for r in sync.lookup_batch(old, wanted).orderBy("ordinal").collect()] == [(0, "b"), (1, None)]


def test_batch_of_queries_shuffles_no_postings(spark):
    """Many queries over many texts give what single ones do, and what is shuffled are k rows a query of a task; one set of queries or several."""
    from tessera.operators import bm25

    def shuffled() -> int:
        jvm = spark._jvm
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    texts = [(f"d{k:05d}", " ".join(f"t{(k * j) % 97}" for j in range(1, 60 + k % 7))) for k in range(4000)]
    docs = spark.createDataFrame([*texts, ("e", None), ("f", "")], "id string, content string").repartition(3).localCheckpoint()
    asked = [(q, f"t{q} T{3 * q % 97} t{q}, none") for q in range(40)]
    queries = spark.createDataFrame([*asked, (77, ""), (78, None), (79, "none")], "query_id int, text string").localCheckpoint()
    before = shuffled()
    got = [tuple(r) for r in bm25.batch_scores(docs, queries, 5).orderBy("query_id", "rank").select("query_id", "id", "score", "rank").collect()]
    assert shuffled() - before < 200_000
    assert len(got) == 200 and {r[0] for r in got} == set(range(40))
    for q in (3, 20):
        one = bm25.top(bm25.scores(docs, bm25.query_terms(asked[q][1])), 5).collect()
        assert [(r["id"], r["score"]) for r in one] == [(r[1], r[2]) for r in got if r[0] == q]
    most, bm25.SET_QUERIES = bm25.SET_QUERIES, 15
    try:
        assert got == [tuple(r) for r in bm25.batch_scores(docs, queries, 5).orderBy("query_id", "rank").select("query_id", "id", "score", "rank").collect()]
    finally:
        bm25.SET_QUERIES = most
    assert bm25.batch_scores(docs, queries.filter("query_id > 100"), 5).collect() == []
