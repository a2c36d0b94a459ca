"""Every named query against its SQL on the smallest folder."""

import math

import duckdb
import pytest

from tessera.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "conversations", "events", "labels")


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return made


def shown(row):
    return tuple(None if x is None or (isinstance(x, float) and math.isnan(x)) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, con, name):
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    mine = sorted(map(repr, (shown(r) for r in got.select(columns).collect())))
    assert mine == sorted(map(repr, map(shown, found.fetchall())))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.columns == ["id", "score", "legs"] and got.count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_scan_only_what_they_need(spark):
    plan = QUERIES["cosine_topk"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "label" not in plan and "Python" not in plan
    plan = QUERIES["bm25_topk"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "lang" not in plan and "SortMergeJoin" not in plan


def test_chunk_queries_take_long_documents(spark, tmp_path):
    from tessera.plans.queries import QUERIES

    long = "word " * 240_000
    spark.createDataFrame([(1, long, "en", "a", len(long))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["chunk_bytes"](spark, str(tmp_path)).count() > 1000
