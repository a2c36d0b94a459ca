"""Approximate nearest neighbours by learned partitions.

Fit, on the driver, on a sample of a sixteenth of the vectors, between ``SAMPLE``
and ``MOST_SAMPLE`` of them: their exact neighbour
graph by inner product is cut into balanced parts (spectral bisection at the
median, refined by swaps, repeated on the halves), and a small network learns
which parts a vector's neighbours lie in.  Index: every vector goes to its most
probable part.  Search: a query is routed to its most probable parts and ranked
exactly against everything in them.  How many parts is measured: vectors of the
sample that the network didn't learn from must find ``RECALL`` of their nearest
in the sample.  Vectors without structure (all directions alike) need most
parts, clustered ones few.

The number of parts follows the number of vectors, up to ``MAX_PARTS``, and a
query probes further parts where those it is due hold too few vectors.  Whole
parts are put together into blocks of about ``BLOCK_BYTES`` of vectors, a part
that is larger is split, the queries of a block are dealt out as well, and every
pair of a block and some of its queries is a task of bounded size that returns k
rows a query at most.  Within a part equal vectors are compared once, and of each
set of equals only the smallest ids that could be among the results are listed.

Defined results: vectors that are null, empty, zero, of another length than the
most common one, or that hold a null or non-finite component take no part, nor
do rows without an id; of rows that share an id the smallest vector counts; equal
scores rank by id; fewer candidates than ``k`` give all of those found; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches

SAMPLE, MOST_SAMPLE = 4096, 32_768
GRAPH_K = 16
PART_ROWS = 800
MIN_PARTS, MAX_PARTS = 8, 2048
RECALL = 0.94
BLOCK_BYTES = 16 << 20
QUERY_ROWS = 2048
HIDDEN = 64


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """For each row the k others with the largest inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), max(k, 0)), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k > 0 else 0
    return out


def _halve(near: np.ndarray, members: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size of ``members`` that cut few neighbour links."""
    place = np.full(int(near.shape[0]), -1)
    place[members] = np.arange(len(members))
    inner = place[near[members]]
    a, slot = np.nonzero(inner >= 0)
    b = inner[a, slot]
    a, b = np.concatenate((a, b)), np.concatenate((b, a))  # links count both ways
    n = len(members)
    degree = np.maximum(np.bincount(a, minlength=n), 1).astype(np.float64)
    v = rng.normal(size=n)
    for _ in range(60):  # second eigenvector of the lazy random walk
        v -= (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * np.bincount(a, v[b], n) / degree
        v /= np.linalg.norm(v) + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(20):  # swap the nodes that gain most, as many from each side
        across = np.bincount(a, side[a] != side[b], n)
        gain = across - (np.bincount(a, minlength=n) - across)
        left, right = (np.flatnonzero((side == s) & (gain > 0)) for s in (False, True))
        m = min(len(left), len(right)) // 2
        if m == 0:
            break
        left, right = (x[np.argsort(-gain[x], kind="stable")[:m]] for x in (left, right))
        side[left], side[right] = True, False
    return members[~side], members[side]


def balanced_parts(near: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """A part for every node of the neighbour graph; parts is a power of two."""
    rng, groups = np.random.default_rng(seed), [np.arange(len(near))]
    while len(groups) < parts:
        groups = [half for g in groups for half in _halve(near, g, rng)]
    out = np.zeros(len(near), np.int64)
    for k, g in enumerate(groups):
        out[g] = k
    return out


@dataclass
class Router:
    """A network with one hidden layer from vectors to log-odds of parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, epochs: int = 40, rate: float = 0.01, seed: int = 5) -> Router:
    """Fit log-odds to rows of target distributions, by Adam."""
    rng, dim, parts = np.random.default_rng(seed), x.shape[1], target.shape[1]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    r = Router(rng.normal(0, dim**-0.5, (dim, HIDDEN)) * 2, np.zeros(HIDDEN), np.zeros((HIDDEN, parts)), np.zeros(parts))
    names = ["w1", "b1", "w2", "b2"]
    m1, m2, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.maximum(unit[rows] @ r.w1 + r.b1, 0)
            z = h @ r.w2 + r.b2
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ r.w2.T) * (h > 0)
            step += 1
            for k, g in zip(names, (unit[rows].T @ dh, dh.sum(0), h.T @ d, d.sum(0)), strict=True):
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                setattr(r, k, getattr(r, k) - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8))
    return r


def parts_for(n: int) -> int:
    """A power of two, so that a part holds about ``PART_ROWS`` of n vectors."""
    return int(min(MAX_PARTS, max(MIN_PARTS, 2 ** round(np.log2(max(1, n / PART_ROWS))))))


def probes_for(router: Router, x: np.ndarray, queries: np.ndarray, k: int, recall: float) -> int:
    """The least number of parts in which ``queries`` (row numbers of x) find the share ``recall`` of their k nearest in x."""
    k = min(k, len(x) - 1)
    near = neighbour_graph(x.astype(np.float32), k)[queries]
    part = router.logits(x).argmax(1)
    order = np.argsort(-router.logits(x[queries]), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(router.parts)[None, :], axis=1)
    needed = np.take_along_axis(place, part[near], axis=1).reshape(-1) + 1
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])


def fit(x: np.ndarray, parts: int, k: int, recall: float = RECALL) -> tuple[Router, int]:
    """A router to at most ``parts`` parts of 8 vectors of the sample or more, and the number of parts to probe."""
    learned = np.flatnonzero(np.arange(len(x)) % 5 != 4)
    parts = min(parts, 1 << max(0, int(np.log2(max(1, len(learned) // 8)))))
    own = x[learned]
    near = neighbour_graph(own.astype(np.float32))
    part = balanced_parts(near, parts)
    around = np.concatenate((np.arange(len(own))[:, None], near), 1)
    target = np.zeros((len(own), parts))
    np.add.at(target, (np.repeat(np.arange(len(own)), around.shape[1]), part[around].reshape(-1)), 1 / around.shape[1])
    router = train_router(own.astype(np.float64), target)
    asked = np.setdiff1d(np.arange(len(x)), learned)
    return router, probes_for(router, x, asked if len(asked) else learned, k, recall) if len(x) > 1 else router.parts


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, one row per id."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _stack(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), np.float64)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed component by component in double precision."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


def rank_block(q_id: np.ndarray, q: np.ndarray, x_id: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score): the k best of a block for each query, ties by id, the query's own id left out."""
    order = np.argsort(x_id, kind="stable")
    x_id, x = x_id[order], x[order]
    distinct, first, kind = np.unique(x, axis=0, return_index=True, return_inverse=True)
    kind = kind.reshape(-1)
    by_kind = np.argsort(kind, kind="stable")  # ids stay in order within a kind
    starts = np.searchsorted(kind[by_kind], np.arange(len(distinct) + 1))
    out = []
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ distinct.T
        m = min(k + 1, s.shape[1])  # the query itself may be one of them
        least = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
        row, col = np.nonzero(s >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
        exact = _exact(q[i + row], distinct[col])
        sizes = np.minimum(starts[col + 1] - starts[col], k + 1)
        at = np.repeat(np.arange(len(row)), sizes)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = x_id[by_kind[starts[col[at]] + nth]]
        own = q_id[i + row[at]]
        keep = ids != own
        found = pd.DataFrame({"query_id": own[keep], "vec_id": ids[keep], "score": exact[at][keep]}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        out.append(found.groupby("query_id", sort=False).head(k))
    return pd.concat(out) if out else pd.DataFrame({"query_id": q_id[:0], "vec_id": x_id[:0], "score": np.zeros(0)})


def lay_out(sizes: dict[int, int], most: int) -> tuple[dict[int, int], dict[int, int]]:
    """(first block, number of blocks) of every part: small parts share a block of about ``most`` rows, larger ones are split."""
    first, split, block, room = {}, {}, 0, most
    for part, n in sorted(sizes.items()):
        if n > room and room < most:
            block, room = block + 1, most
        first[part], split[part] = block, -(-n // most)
        if n >= most:
            block, room = block + split[part], most
        else:
            room -= n
    return first, split


def search(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", sample: int | None = None, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` (a condition on vec_id) holds, its k nearest found."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    id_type = rows.schema["vec_id"].dataType.simpleString()
    if not sizes:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    rows = rows.filter(F.size("v") == dim)
    place = F.conv(F.substring(F.md5(F.col("vec_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    sample = sample or min(MOST_SAMPLE, max(SAMPLE, n // 16))
    taken = rows.filter(place < sample / n).toPandas().sort_values("vec_id")
    router, probes = fit(_stack(taken["v"]).reshape(-1, dim), parts_for(n), k, recall)

    @F.pandas_udf("int")
    def part_of(v: pd.Series) -> pd.Series:
        return pd.Series(router.logits(_stack(v).reshape(-1, dim)).argmax(1).astype(np.int32))

    index = materialize(rows.withColumn("part", part_of.asNondeterministic()("v")), "index")
    # parts are at most MAX_PARTS, so their sizes are a small table
    held = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}
    first, split = lay_out(held, max(1024, BLOCK_BYTES // (8 * dim)))

    own_sizes = np.array([held.get(p, 0) for p in range(router.parts)])

    @F.pandas_udf("array<struct<block: int, parts: array<int>>>")
    def blocks_of(v: pd.Series) -> pd.Series:
        order = np.argsort(-router.logits(_stack(v).reshape(-1, dim)), axis=1, kind="stable")
        # as many parts as were found to do, and more until they hold k besides the query
        enough = np.maximum((np.cumsum(own_sizes[order], axis=1) <= k).sum(1) + 1, probes)
        out = []
        for own, most in zip(order.tolist(), enough.tolist(), strict=True):
            at: dict[int, list[int]] = {}
            for p in own[:most]:
                for nth in range(split.get(p, 0)):
                    at.setdefault(first[p] + nth, []).append(p)
            out.append([{"block": block, "parts": parts} for block, parts in at.items()])
        return pd.Series(out)

    routed = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), blocks_of.asNondeterministic()("v").alias("to"))
    routed = materialize(routed.select("query_id", "q", F.explode("to").alias("e")).select("query_id", "q", "e.block", "e.parts"), "queries")
    # how many groups the queries of a block are dealt out in: a row a block, joined, since blocks grow with the data
    asked = routed.groupBy("block").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("groups"))
    asked = materialize(asked, "asked")
    look = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), key)  # noqa: E731  # a row a part
    block = look(first, F.col("part")) + F.pmod(F.xxhash64("vec_id"), look(split, F.col("part"))).cast("int") if held else F.lit(0)
    left = index.select(block.alias("block"), "part", "vec_id", "v").join(asked, "block")
    left = left.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    right = routed.join(asked, "block").withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).drop("groups")

    def rank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        if len(a) and len(b):
            q_id, q, x_id, x = b["query_id"].to_numpy(), _stack(b["q"]), a["vec_id"].to_numpy(), _stack(a["v"])
            part, probing = a["part"].to_numpy(), b["parts"].tolist()
            for p in np.unique(part):
                mine, theirs = part == p, np.array([p in parts for parts in probing])
                if theirs.any():
                    found.append(rank_block(q_id[theirs], q[theirs], x_id[mine], x[mine], k))
        together = pd.concat(found[1:] or found)
        return together.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)

    keys = ["block", "q_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rank, f"query_id {id_type}, vec_id {id_type}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
