"""The graph of neighbours: recall, how much of the vectors a search looks at, edges and odd vectors."""

import numpy as np
import pytest

from tessera.operators import neighbour_graph as g, vector
from tessera.plans.queries import QUERIES

TYPE = "id long, vector array<double>"


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_on_the_embeddings(spark, folder):
    where = f"/root/testdata/{folder}"
    exact, near = ({(r["query_id"], r["id"]): (r["rank"], r["score"]) for r in QUERIES[name](spark, where).collect()} for name in ("cosine_batch", "ann_graph_topk"))
    assert len(near) == len(exact) and len(set(exact) & set(near)) / len(exact) >= 0.9
    assert all(near[k][1] == pytest.approx(exact[k][1], abs=2e-6) for k in set(exact) & set(near))


@pytest.fixture(scope="module")
def clustered(spark):
    """4,000 vectors around 200 centres, some equal, some without a direction."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((200, 24))
    x = centres[rng.integers(0, 200, 4000)] + 0.4 * rng.standard_normal((4000, 24))
    x[100:700] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [])]
    return spark.createDataFrame(rows, TYPE).repartition(4)


def test_a_search_looks_at_a_part(spark, clustered):
    graph, units = g.build(clustered)
    assert units.count() == 4000
    asked = clustered.filter("id % 200 = 3 OR id > 4999").selectExpr("id AS query_id", "vector AS query")
    found = g.search(graph, units, asked, 10, width=48)
    got, scored = found.top.collect(), found.scored
    exact = {(r["query_id"], r["id"]): r["score"] for r in vector.batch_top(units.withColumnRenamed("v", "vector"), asked.filter("query_id < 5000"), 10).collect()}
    # equal vectors stand for each other, so scores are compared
    want, have = {}, {}
    for (q, _), s in exact.items():
        want.setdefault(q, []).append(s)
    for r in got:
        have.setdefault(r["query_id"], []).append(r["score"])
    assert set(have) == set(want) and {r["rank"] for r in got} == set(range(1, 11))
    hits = sum(sum(s >= min(want[q]) - 2e-6 for s in have[q]) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert scored.count() == scored.select("query_id", "id").distinct().count() < 0.2 * 4000 * len(want)


def test_graph_is_bounded_and_sound(spark, clustered):
    graph, units = g.build(clustered, degree=6, rounds=1)
    edges = graph.collect()
    of = {r["id"]: np.array(r["v"]) for r in units.collect()}
    assert len(edges) == len({(r["id"], r["nb"]) for r in edges}) and all(r["id"] != r["nb"] for r in edges)
    assert all(r["sim"] == pytest.approx(float(of[r["id"]] @ of[r["nb"]]), abs=1e-9) for r in edges[::97])
    counts = graph.groupBy("id").count().agg({"count": "max"}).first()[0]
    assert counts <= 3 * 6 and graph.select("id").distinct().count() == 4000


def test_few_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0])], TYPE)
    for rows, expected in ((one, {(1, 1)}), (one.limit(0), set()), (one.unionByName(spark.createDataFrame([(2, [0.0, 1.0])], TYPE)), {(1, 1), (1, 2)})):
        found = g.search(*g.build(rows), one.selectExpr("id AS query_id", "vector AS query"), 5)
        assert {(r["query_id"], r["id"]) for r in found.top.collect()} == expected


def _shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    jvm = spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_pairs_do_not_carry_vectors(spark):
    """Where nothing is small enough to be broadcast, a build shuffles under 60 kB a vector, and finds most true neighbours."""
    x = np.random.default_rng(8).standard_normal((3000, 64)).astype(np.float32)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<float>").repartition(4).localCheckpoint()
    before, limit = _shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph, _ = g.build(vectors, leaf=500)
        assert _shuffled(spark) - before < 60_000 * len(x)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    unit = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    sims = unit @ unit.T
    np.fill_diagonal(sims, -1)
    true = {(i, int(j)) for i, near in enumerate(np.argsort(-sims, axis=1)[:, : g.DEGREE]) for j in near}
    assert len(true & {(r["id"], r["nb"]) for r in graph.collect()}) > 0.8 * len(true)
