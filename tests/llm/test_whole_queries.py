"""The registered queries that SQL can't express, over whole folders, against brute force or on documents they did not learn from."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_corpus_operators import plain_components, plain_fingerprint

from tessera.llm import packing, queries

FOLDER = "/root/testdata/sf0.001"


def rows_of(name, *columns, folder=FOLDER):
    return [tuple(r[c] for c in columns) for r in pq.read_table(f"{folder}/{name}.parquet", columns=list(columns)).to_pylist()]


def fold(i, k):
    return zlib.crc32(str(i).encode()) % k


def run(spark, name, folder=FOLDER):
    return queries.queries()[name](spark, folder).collect()


def test_op1_scores_and_folds(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in run(spark, "op1_quality", folder)}
    assert sorted(got) == sorted(i for (i,) in rows_of("documents", "doc_id", folder=folder))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (fold(i, 3) == 1) for i, r in got.items())
    held = [(got[i]["predicted"], label) for i, label in rows_of("labels", "doc_id", "quality", folder=folder) if i in got and fold(i, 3) == 1]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.95


def test_op4_base_and_counts(spark):
    docs = [(i, [w.decode() for w in (t or "").encode().lower().split()]) for i, t in rows_of("documents", "doc_id", "text")]
    counts, ends = Counter(), 0
    for i, words in docs:
        if fold(i, 7) != 2:
            counts.update(words)
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    log = lambda c: math.log10((c + 1) / (total + distinct + 1))
    got = {r["doc_id"]: r for r in run(spark, "op4_recurrent")}
    assert len(got) == len(docs)
    for i, words in docs:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i, 7) == 2, len(words) + 1, sum(counts[w] > 0 for w in words) + 1, total)
        assert r["base_score"] == pytest.approx(sum(log(counts[w]) for w in words) + log(ends), rel=1e-9) and math.isfinite(r["score"]) and r["score"] < 0


def test_op5_against_brute_force(spark):
    docs = rows_of("documents", "doc_id", "text")
    prints = [plain_fingerprint(t, 4) for _, t in docs]
    comps = plain_components([(i, f) for (i, _), f in zip(docs, prints, strict=True)])
    expected = Counter((i, f"{f & (2**64 - 1):016x}", c) for (i, _), f, c in zip(docs, prints, comps, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, "op5_simhash")) == expected


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_op6_recall_against_exact_search(spark, folder):
    where = f"/root/testdata/{folder}"
    pairs = rows_of("embeddings", "vec_id", "embedding", folder=where)
    ids, x = np.array([i for i, _ in pairs]), np.array([v for _, v in pairs], np.float64)
    got = defaultdict(list)
    for r in run(spark, "op6_neighbours", where):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    asked = [k for k, i in enumerate(ids) if i % 20 == 0]
    assert sorted(got) == sorted(int(ids[k]) for k in asked)
    hits = 0
    for k in asked:
        found = sorted(got[int(ids[k])])
        scores = x @ x[k]
        exact = [int(i) for s, i in sorted(zip(-scores, ids, strict=True)) if i != ids[k]][:20]
        assert [r for r, *_ in found] == list(range(1, 21)) and [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len(set(exact) & {i for _, i, _ in found})
    assert hits / (20 * len(asked)) >= 0.93


def test_op7_predicts_documents_it_did_not_learn_from(spark):
    folder = "/root/testdata/sf0.01"
    docs = {i: (t, lang) for i, t, lang in rows_of("documents", "doc_id", "text", "lang", folder=folder)}
    got = {r["doc_id"]: r for r in run(spark, "op7_langid", folder)}
    assert set(got) == set(docs) and all(r["held_out"] == (fold(i, 3) == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    letters = {i for i, (t, _) in docs.items() if t and any(c.isalpha() for c in t)}
    assert all((got[i]["lang_pred"] == "und") == (i not in letters) for i in docs)
    held = [got[i]["lang_pred"] == docs[i][1] for i in letters if docs[i][1] and fold(i, 3) == 1]
    assert np.mean(held) > 0.99


def test_op9_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer, expected = Tokenizer.from_file(queries.tokenizer_path()), Counter()
    for i, t in rows_of("documents", "doc_id", "text"):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for a, n in packing.pieces(len(ids)):
            expected[(i, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()), len(ids))] += 1
    got = run(spark, "op9_pack")
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == expected
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 and r["bucket"] == r["length"] for r in got)
