"""The toxicity network against plain loops and finite differences, and on documents it did not learn from."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tests_llm_data import prose

from tessera.llm import queries, toxicity as x

NAMES = ("gates", "new", "look", "out", "offset")


def weights():
    return {k: v.astype(np.float64) for k, v in x.new_weights(5).items() if k in NAMES}


def plain_odds(w, products):
    """One window, word by word: ``products`` is (words, 6 * HIDDEN)."""
    h = x.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    sides = []
    for side, order in ((0, range(len(products))), (1, range(len(products) - 1, -1, -1))):
        state, out = np.zeros(h), {}
        for k in order:
            into = products[k, side * 3 * h : (side + 1) * 3 * h]
            both = sig(into[: 2 * h] + state @ w["gates"][side])
            fresh = np.tanh(into[2 * h :] + (both[h:] * state) @ w["new"][side])
            state = (1 - both[:h]) * state + both[:h] * fresh
            out[k] = state
        sides.append(out)
    states = np.array([np.concatenate((sides[0][k], sides[1][k])) for k in range(len(products))]).reshape(-1, 2 * h)
    if not len(states):
        return float(w["offset"][0])
    share = np.exp(states @ w["look"])
    return float((share / share.sum()) @ (states @ w["out"]) + w["offset"][0])


def test_network_against_plain_loops():
    rng, w = np.random.default_rng(1), weights()
    products = rng.standard_normal((40, 6 * x.HIDDEN))
    slots = [np.arange(n) + a for n, a in ((9, 3), (9, 20), (4, 0), (1, 7), (0, 0))]
    grid, lengths, _ = x.laid_out(products, slots)
    assert x.run(w, grid, lengths) == pytest.approx([plain_odds(w, products[s]) for s in slots], abs=1e-5)


def test_gradients_against_differences():
    rng, w = np.random.default_rng(0), weights()
    grid, lengths, y = rng.standard_normal((5, 2, 4, 3 * x.HIDDEN)), np.array([5, 3, 2, 0]), np.array([1, 0, 1, 0.0])

    def loss():
        z = x.run(w, grid, lengths)
        return float((np.logaddexp(0, z) - y * z).sum())

    _, g, dx = x.gradients(w, grid, lengths, lambda z: x._sigmoid(z) - y)
    for values, grads in [*((w[k], g[k]) for k in NAMES), (grid, dx)]:
        flat, own = values.ravel(), np.asarray(grads).ravel()
        for i in rng.integers(0, flat.size, 12):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert own[i] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_windows_overlap_and_cover():
    for n in [*range(0, 200), 1000]:
        found = x.windows(n)
        covered = {k for s, m in found for k in range(s, s + m)}
        assert covered == set(range(n)) and all(m <= x.WINDOW for _, m in found) and len(found) == len(set(found)) >= 1
        assert all(b[0] - a[0] == x.STRIDE and b[0] < a[0] + a[1] for a, b in zip(found, found[1:], strict=False))


def test_documents_score_as_their_worst_window():
    rng = random.Random(2)
    model = x.Model(x.new_weights(1))
    texts = [x.words_of(prose(rng, n)) for n in (0, 1, 47, 48, 49, 300, 90_000)]
    got = model.odds(texts)
    w = model.weights
    for words, z in list(zip(texts, got, strict=True))[:-1]:
        word, grams, begins = x.describe(words)
        vectors = w["word"][word] + x._sums(w["gram"], grams, begins) if words else np.zeros((0, x.WIDTH))
        products = vectors @ w["into"] + w["bias"]
        assert z == pytest.approx(max(plain_odds(w, products[s : s + n]) for s, n in x.windows(len(words))), abs=1e-4)
    again = x.Model(x.new_weights(1))
    assert again.odds(texts[::-1])[::-1] == pytest.approx(got, abs=1e-5)


def test_words_have_their_own_grams():
    words = [b"abc", b"abcdefgh", b"x"]
    word, grams, begins = x.describe(words)
    ends = [*begins[1:], len(grams)]
    for k, one in enumerate(words):
        w, g, _ = x.describe([one])
        assert w[0] == word[k] and sorted(g) == sorted(grams[begins[k] : ends[k]])
    assert len(grams[begins[0] : ends[0]]) == len("\1abc") - 2 + 1  # two of three bytes, the first four


def test_forgetting_words_changes_nothing(monkeypatch):
    rng = random.Random(4)
    texts = [x.words_of(prose(rng, 400)) for _ in range(30)]
    whole = x.Model(x.new_weights(1)).odds(texts)
    monkeypatch.setattr(x, "KEPT_WORDS", 600)
    small = x.Model(x.new_weights(1))
    assert np.concatenate([small.odds([t]) for t in texts]) == pytest.approx(whole, abs=1e-5)


LABELS = "doc_id long, toxic int"


def test_edges(spark, docs, clashing, empty):
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in x.classify(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(k, 1) for k in range(1, 20)] + [(3, None), (None, 1), (4, 7)], LABELS)
    assert all(r["score"] > 0.99 and r["predicted"] == 1 for r in x.classify(docs, ones).collect())
    mixed = spark.createDataFrame([(k, k % 2) for k in range(1, 60)] + [(8, 1), (None, 0)], LABELS)
    got = x.classify(clashing, mixed).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by_id[7]) == 1 and by_id[5] == by_id[6] and by_id[1] == by_id[2]  # equal texts; no words
    assert x.classify(empty, mixed).count() == 0


def test_sample_is_bounded_and_texts_are_scored_whole(spark):
    rng = random.Random(6)
    rows = [(1, prose(rng, 30))] * 300 + [(k, prose(rng, 30) + (" zzidiot" if k % 2 else "")) for k in range(2, 600)]
    rows.append((1001, prose(rng, 60_000) + " zzidiot zzidiot zzidiot " + prose(rng, 10)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(2, 600)] + [(1, 0)], LABELS)
    got = {r["doc_id"]: r["predicted"] for r in x.classify(docs, labels, max_rows=400).collect()}
    assert got[1001] == 1 and np.mean([got[k] == k % 2 for k in range(1, 600)]) > 0.95


def test_op12_on_documents_it_did_not_learn_from(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.queries()["op12_toxicity"](spark, folder).collect()}
    read = lambda name, *columns: [tuple(r[c] for c in columns) for r in pq.read_table(f"{folder}/{name}.parquet", columns=list(columns)).to_pylist()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    assert set(got) == {i for (i,) in read("documents", "doc_id")}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (fold(i) == 0) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, y in read("labels", "doc_id", "toxic") if fold(i) == 0 and i in got]
    assert len(held) > 500 and np.mean([p == y for p, y in held]) > 0.95
    assert np.mean([p for p, y in held if y]) > 0.7 and np.mean([p for p, y in held if not y]) < 0.03


def test_training_is_repeatable():
    rng = random.Random(9)
    texts = [x.words_of(prose(rng, 60) + (" zzidiot" if k % 2 else "")) for k in range(60)]
    y = np.array([k % 2 for k in range(60)], float)
    a, b = x.fit_rows(texts, y, (0.5, 0.5)), x.fit_rows(texts, y, (0.5, 0.5))
    assert all((a.weights[k] == b.weights[k]).all() for k in a.weights) and (a.scale, a.shift) == (b.scale, b.shift)
