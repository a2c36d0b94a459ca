"""Quality, language ID, outliers and LM scoring on awkward and synthetic documents."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from tests_llm_data import awkward_rows, prose

from tessera.llm import langid, outliers, quality, recurrent

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


# -- quality -----------------------------------------------------------------


def quality_rows(n=400):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        good = k % 3 != 0
        text = prose(rng, 40) if good else " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in prose(rng, 40).split())
        rows.append((k, text, int(good)))
    return rows


def test_quality_learns_and_holds_out(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [(got[i]["predicted"], q) for i, _, q in rows if crc(i) % 3 == 1]
    assert np.mean([p == q for p, q in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_quality_awkward(docs, clashing, empty, spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(awkward_rows())
    by_text = {}
    for r in got:
        assert 0 <= r["score"] <= 1
        by_text.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by_text[7]) == 1  # repeated rows score equally
    assert by_text[1] == by_text[0] or len(by_text[1]) == 1
    assert quality.classify(clashing, labels).count() == len(got)
    assert quality.classify(empty, labels).count() == 0
    none = quality.classify(docs, labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_model_is_tables():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair tells
    model = quality.train(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    by_hand = model.base + sum(t[np.searchsorted(c, x[5, j], "right")] for j, (c, t) in enumerate(zip(model.cuts, model.tables, strict=True)))
    for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
        by_hand += t[np.searchsorted(model.pair_cuts[i], x[5, i], "right"), np.searchsorted(model.pair_cuts[j], x[5, j], "right")]
    assert model.raw(x[5:6])[0] == pytest.approx(by_hand)


# -- language ID -------------------------------------------------------------


def language_rows(n=300):
    rng = random.Random(2)
    kinds = {"aa": "an er on en re nt th ti ou es", "bb": "ñu ló qí ya zé xi wo gu", "cc": "sch ung keit ver ich ein zu ß"}
    return [(k, prose(rng, rng.randint(5, 60), kinds[lang]), lang) for k in range(n) for lang in [("aa", "bb", "cc")[k % 3]]]


def test_langid_learns(spark):
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r["doc"]["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if crc(i) % 3 == 1]) > 0.97
    assert sum(r["rejected"] for r in got.values()) <= 2
    assert model.predict("привет мир как дела сегодня")[1] < model.predict(rows[0][1])[1]
    assert model.predict("1234 ### !!") == ("und", 0.0) and model.predict(None) == ("und", 0.0) and model.predict("") == ("und", 0.0)


def test_langid_long_text_is_read_in_steps(monkeypatch):
    rows = language_rows(60)
    model = langid.train([t for _, t, _ in rows], [lang for _, _, lang in rows])
    text = " ".join(t for _, t, lang in rows if lang == "bb")
    whole = model.predict(text)
    monkeypatch.setattr(langid, "_STEP", 100)
    assert model.predict(text)[0] == whole[0] and model.predict(text)[1] == pytest.approx(whole[1], abs=1e-6)


def test_langid_awkward(docs, clashing, empty):
    model = langid.fit(docs)
    got = langid.identify(clashing, model).collect()
    assert len(got) == len(awkward_rows())
    for r in got:
        text = r["doc"]["text"]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in model.languages
    assert langid.accepted(clashing, model).columns == clashing.columns
    assert langid.accepted(empty).count() == 0
    nothing = langid.fit(docs.filter("lang IS NULL"))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


@pytest.mark.parametrize("missing", ["de", "fr", "es"])
def test_langid_rejects_a_language_it_never_met(missing):
    """Trained without one of the languages of sf0.01, nearly all of its documents are rejected, and none of the others'."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    rows = [r for r in rows if r["text"] and r["lang"] and any(c.isalpha() for c in r["text"])]
    learned = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] != missing]
    model = langid.train_segments([langid.drawn_segments(r["text"], langid.DOC_BYTES) for r in learned], [r["lang"] for r in learned])
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    gone = {kind: np.mean([model.judge(r["text"])[2] for r in held if (r["lang"] == missing) == kind]) for kind in (True, False)}
    assert gone[True] > 0.9 and gone[False] < 0.01, gone


def test_langid_sample_is_held_narrowly():
    """The driver holds all subwords of the sample; they take two bytes each, not eight."""
    import tracemalloc

    from tessera.llm import langid

    langid.letters()
    rng = np.random.default_rng(3)
    texts = [[" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(2000))] for _ in range(100)]
    held = sum(len(langid.subwords(t)) for (t,) in texts)
    tracemalloc.start()
    langid.train_segments(texts, ["en", "de"] * 50, epochs=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held > 4_000_000 and peak < 6 * held + (24 << 20)


def test_langid_draws_from_all_over_long_texts():
    text = " ".join(f"w{k}" for k in range(50_000))
    parts = langid.drawn_segments(text, 4096)
    places = [int(re.search(r"w(\d+)", p)[1]) for p in parts]
    assert 2000 < sum(map(len, parts)) <= 4096 and places == sorted(places) and places[-1] > 25_000 and parts == langid.drawn_segments(text, 4096)
    assert langid.drawn_segments("ab cd", 4096) and "".join(langid.drawn_segments("é" * 9000, 1000)) and all(len(p) <= 256 for p in langid.drawn_segments("é" * 9000, 1000))


def test_langid_learns_every_language(spark):
    """More languages than documents a language of some, one of them in long texts only."""
    rng = random.Random(9)
    rows = [(k, prose(rng, 30, f"{chr(97 + k % 13)}x {chr(110 + k % 13)}y zq"), f"l{k % 260:03}") for k in range(1040)]
    rows += [(2000 + k, prose(rng, 300_000, "ωα βη γι δο"), "long") for k in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=4)
    assert "long" in model.languages and len(model.languages) > 250
    assert model.predict(prose(rng, 50, "ωα βη γι δο"))[0] == "long"


# -- outliers ----------------------------------------------------------------


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_outliers_base_counts(spark):
    texts = [None, "", " ", "a b c", "a b c a b c", "a a a a", "x\nx\n\nx y\nx", "a b c d a b c e a b c", "#a $$ | <b>\n\n \n", "\U0001f600 é", "a b a b a"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, awkward_rows()[5][1])], "k long, text string")
    for r in outliers.base_counts(docs).collect():
        text = texts[r["doc"]["k"]] if r["doc"]["k"] < 99 else awkward_rows()[5][1]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_counts(text), text


def test_outliers_reject_the_odd_and_keep_the_rest(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randint(60, 200)), "en", f"s{k % 2}") for k in range(300)]
    rows += [(1000 + k, " | ".join(prose(rng, 80).split()), "en", "s0") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc"]["doc_id"]: r for r in outliers.judge(docs).collect()}
    assert not any(got[1000 + k]["kept"] for k in range(6))
    assert all(got[k]["kept"] for k in range(300))


def test_outliers_distances_match_numpy(spark):
    """One group, the same concentration steps from the same starts in numpy, the smallest determinant: equal verdicts, close distances."""
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.randint(55, 300)), "en", "s") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc"]["doc_id"]: r for r in outliers.judge(docs).collect()}
    x, ids = [], []
    for k, text, _, _ in rows:
        n, chars, symbols, dup, repeats = base_counts(text)
        if n >= 50 and 100 * repeats <= 50 * n:
            v = [math.log(n), chars / n, math.log(0.01 + symbols / n), dup / max(dup + n / 20, 1), math.sqrt(repeats / n)]
            x.append(np.round(np.array(v) * outliers.SCALE) / outliers.SCALE)
            ids.append(k)
    x = np.array(x)
    floor = np.diag(np.square(outliers.FLOORS))
    q = [np.sort(np.floor(x * outliers.GRID), axis=0)[math.ceil(p * len(x)) - 1] for p in (0.25, 0.5, 0.75)]
    median = (q[1] + 0.5) / outliers.GRID
    ends = []
    for centre, cov in ((median, np.diag(np.square((q[2] - q[0]) / (outliers.GRID * 1.349))) + floor), (median, floor), (x.mean(0), np.cov(x.T, bias=True) + floor)):
        for _ in range(outliers.STEPS):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            cell = np.floor(np.log(d + 1e-9) * outliers.GRID)
            close = x[cell <= np.sort(cell)[math.ceil(outliers.SUBSET * len(x)) - 1]]
            centre, cov = close.mean(0), np.cov(close.T, bias=True) + floor
        ends.append((np.linalg.det(cov), centre, cov))
    _, centre, cov = min(ends, key=lambda e: e[0])
    d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    cell = np.sort(np.floor(np.log(d + 1e-9) * outliers.GRID))[math.ceil(0.5 * len(x)) - 1]
    d /= max(1.0, math.exp((cell + 0.5) / outliers.GRID) / outliers.CHI2_MEDIAN)
    for k, v in zip(ids, d, strict=True):
        assert got[k]["distance"] == pytest.approx(v, rel=1e-6)
        assert got[k]["kept"] == (v <= outliers.CUTOFF)


def test_outliers_smallest_determinant_wins(spark):
    """Two clusters: the start whose steps end in the tighter majority is the one that counts, whatever the order of the rows."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(0, 0.3, (160, 5)), rng.normal(4, 2.0, (40, 5))))
    x = np.round(x * outliers.SCALE) / outliers.SCALE
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], ", ".join(["grp string", *[f"x{i} double" for i in range(5)]]))
    one = outliers.estimates(rows).first()
    two = outliers.estimates(rows.orderBy(F.desc("x0")).repartition(5)).first()
    assert one == two and all(abs(one[f"m{i}"]) < 0.2 for i in range(5))
    hot = rows.unionByName(rows.withColumn("grp", F.concat(F.lit("h"), (F.rand(1) * 4).cast("int"))))
    assert {r["grp"] for r in outliers.estimates(hot).collect()} == {"g", "h0", "h1", "h2", "h3"}


def test_outliers_many_groups_beside_a_hot_one(spark):
    """2,500 groups, of which one has half of all rows: its estimate is that of the group alone."""
    xs = [f"round(pmod(hash(id, {k}), 1000) / 250.0 * 4096) / 4096 AS x{k}" for k in range(outliers.P)]
    rows = spark.range(20_000).selectExpr("if(id % 2 = 0, 'hot', concat('g', id % 5000)) AS grp", *xs)
    got = {r["grp"]: r for r in outliers.estimates(rows).collect()}
    assert len(got) == 2501
    assert got["hot"] == outliers.estimates(rows.filter("grp = 'hot'")).first()


def test_outliers_awkward(docs, clashing, empty):
    got = outliers.judge(clashing).collect()
    assert len(got) == len(awkward_rows())
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert outliers.judge(empty).count() == 0
    plan = outliers.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


# -- LM scoring --------------------------------------------------------------


def test_recurrent_base_and_counts(docs, clashing, empty):
    got = recurrent.score(clashing, sample_docs=20, vocabulary=50, head=30).collect()
    rows = awkward_rows()
    assert len(got) == len(rows)
    lowered = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(t or "")]
    counts, ends = Counter(), 0
    for i, t, *_ in rows:
        if zlib.crc32(("null" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(lowered(t))
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    expected = Counter()
    for i, t, *_ in rows:
        w = lowered(t)
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w) + math.log10((ends + 1) / (total + distinct + 1))
        expected[(i, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total, round(base, 4))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert recurrent.score(empty).count() == 0


def test_recurrent_learns_and_carries_state():
    rng = np.random.default_rng(0)
    docs = []
    for _ in range(300):  # after the first word everything is decided: a state that is carried knows it
        kind = int(rng.integers(2))
        docs.append(np.array([2 + kind, *([4 + kind] * int(rng.integers(5, 60))), 0], np.int32))
    counts = np.bincount(np.concatenate(docs), minlength=6).astype(float)
    net = recurrent.train(docs, counts, epochs=12, window=8, lanes=32, classes=3, hidden=8, width=4)
    before = recurrent.new_network(counts, classes=3, hidden=8, width=4)
    new, old = (recurrent.score_documents(n, docs, n.gates()).sum() for n in (net, before))
    assert new > 0.5 * old
    alone = recurrent.score_documents(net, docs[3:4], net.gates())[0]
    assert alone == pytest.approx(recurrent.score_documents(net, docs, net.gates(), lanes=7)[3], abs=1e-3)


def test_recurrent_is_a_distribution():
    counts = np.array([5.0, 3, 9, 2, 4, 1, 1])
    net = recurrent.train([np.array([2, 3, 4, 0], np.int32)] * 10, counts, epochs=2, classes=3, hidden=6, width=4)
    state = np.random.default_rng(1).normal(size=(1, 6)).astype(np.float32)
    p = np.exp(net.log_likelihood(np.repeat(state, 7, 0), np.arange(7)))
    assert p.sum() == pytest.approx(1, abs=1e-5)
    made = recurrent.speller([b"abc", b"abd", b"xyz"])
    cube = np.exp(made.table.reshape(64, 64, 64).astype(float)).sum(2)
    assert np.allclose(cube, 1, atol=1e-4)


def test_recurrent_gradients():
    """Backpropagation against finite differences, through the output and the last step's state."""
    rng = np.random.default_rng(4)
    net = recurrent.new_network(np.array([5.0, 3, 9, 2, 4]), classes=2, hidden=4, width=3)
    net.to_class += rng.normal(0, 0.5, net.to_class.shape).astype(np.float32)
    net.to_word += rng.normal(0, 0.5, net.to_word.shape).astype(np.float32)
    states, goals = rng.normal(size=(6, 4)), rng.integers(0, 5, 6)
    grads = {k: np.zeros_like(getattr(net, k), dtype=np.float64) for k in ("to_class", "class_bias", "to_word", "word_bias")}
    d = recurrent._output_gradient(net, states, goals, grads)
    for i, j in ((0, 0), (3, 2)):
        up, down = states.copy(), states.copy()
        up[i, j] += 1e-4
        down[i, j] -= 1e-4
        numeric = -(net.log_likelihood(up, goals).sum() - net.log_likelihood(down, goals).sum()) / 2e-4
        assert d[i, j] == pytest.approx(numeric, abs=1e-3)


def test_recurrent_gradients_through_time():
    """All weights against finite differences of a window's mean loss, over several steps, lanes and a fresh start."""
    from dataclasses import replace

    rng = np.random.default_rng(5)
    net = recurrent.new_network(np.array([5.0, 3, 9, 2, 4, 7]), classes=3, hidden=4, width=3)
    net = replace(net, **{k: getattr(net, k).astype(np.float64) + rng.normal(0, 0.4, getattr(net, k).shape) for k in recurrent.WEIGHTS})
    docs = [rng.integers(0, 6, n) for n in (7, 5, 4, 9)]
    given, goals, doc, first = next(recurrent._lanes(docs, 3, 12))
    state = rng.normal(size=(3, 4))

    def loss(net) -> float:
        h, table, total = state, net.gates(), 0.0
        for t in range(len(goals)):
            h = net.step(np.where(first[t][:, None], 0.0, h), table[given[t]])[0]
            total -= net.log_likelihood(h, goals[t])[doc[t] >= 0].sum()
        return total / (doc >= 0).sum()

    grads, _ = recurrent.gradients(net, state, given, goals, doc >= 0, first)
    for k in recurrent.WEIGHTS:
        w = getattr(net, k)
        for at in rng.permutation(w.size)[:8]:
            moved = []
            for step in (1e-5, -1e-5):
                other = w.copy()
                other.reshape(-1)[at] += step
                moved.append(loss(replace(net, **{k: other})))
            assert grads[k].reshape(-1)[at] == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=1e-6), k


def test_lanes_cover_every_word_once():
    rng = np.random.default_rng(2)
    docs = [rng.integers(1, 99, n) for n in (1, 40, 3, 200, 17, 5, 64, 2)]
    seen = [[] for _ in docs]
    for given, goals, doc, first in recurrent._lanes(docs, 3, 16):
        assert (doc[0] >= 0).all()
        for t in range(len(goals)):
            for lane in range(goals.shape[1]):
                if (k := doc[t, lane]) >= 0:
                    assert first[t, lane] == (not seen[k]) and given[t, lane] == (seen[k][-1] if seen[k] else 0)
                    seen[k].append(goals[t, lane])
    assert all(list(d) == s for d, s in zip(docs, seen, strict=True))


def test_a_million_words_in_a_bounded_worker():
    """One text of 1,000,000 words beside 999 short ones is scored in under 500 MB."""
    import subprocess
    import sys

    code = """
import numpy as np, pandas as pd
from tessera.llm import recurrent as r
words = [b"w%d" % k for k in range(5000)]
tail = r.tail_groups(r.speller(words[4000:]), [words[k:k+40] for k in range(0, 4000, 20)], words[4000:])
n = tail.profile.shape[1]
rows = np.concatenate((1 + n + np.arange(4000), 1 + tail.groups(words[4000:]), [0])).astype(np.int32)
net = r.new_network(np.ones(1 + n + 4000))
model = r.Model(net, net.gates(), r.Lexicon({w: k for k, w in enumerate(words)}, 4000, tail, rows), np.zeros(5001), np.zeros(5001), 0.0)
rng = np.random.default_rng(0)
texts = [" ".join(f"w{k}" for k in rng.integers(0, 6000, size)) for size in [1_000_000] + [20] * 999]
batch = pd.DataFrame({"uid": range(1000), "doc_id": "1", "held_out": False, "text": texts})
got = pd.concat(r._score_batches(model, iter([batch])))
assert len(got) == 1000 and got["n_tokens"].max() == 1_000_001 and np.isfinite(got["score"]).all()
print(next(int(x.split()[1]) // 1024 for x in open('/proc/self/status') if x.startswith('VmHWM')))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert int(done.stdout.split()[-1]) < 500


def test_every_training_segment_is_learned_from(spark, monkeypatch):
    """The driver's segments and those of the pass are all training words and ends, each once, also in a corpus of which a sixteenth was enough before."""
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(k % 700))) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(recurrent, "SAMPLE_TOKENS", 10_000)
    first, passed = [], []
    train, whole_pass = recurrent.train, recurrent.whole_pass
    monkeypatch.setattr(recurrent, "train", lambda docs, *a, **k: first.extend(docs) or train(docs, *a, **k))
    monkeypatch.setattr(recurrent, "whole_pass", lambda net, segments, total: passed.extend(segments.collect()) or whole_pass(net, segments, total))
    got = recurrent.score(docs, sample_docs=100, vocabulary=50, classes=5).collect()
    pass_tokens = sum(len(r["numbers"]) // recurrent.ROW_BYTES for r in passed)
    assert sum(map(len, first)) + pass_tokens == got[0]["train_tokens"] == sum(r["n_tokens"] for r in got if not r["held_out"])
    assert sum(map(len, first)) < 0.1 * pass_tokens and all(np.frombuffer(r["numbers"], recurrent.ROW).max() < 70 for r in passed)


def test_groups_of_spelling_are_distributions():
    rng = random.Random(3)
    kinds = ["an er on en re nt", "le qa xu zo ki wy"]
    texts = [[w.encode() for w in prose(rng, 60, kinds[k % 2]).split()] for k in range(80)]
    words = sorted({w for t in texts for w in t})
    tail = recurrent.tail_groups(recurrent.speller(words), texts, words, groups=2)
    assert np.allclose(np.exp(tail.tables.reshape(2, 64, 64, 64).astype(float)).sum(3), 1, atol=1e-3)
    own = [np.bincount(tail.groups(t), minlength=2) for t in texts]
    assert all(x.argmax() == own[k % 2].argmax() and x.max() > 0.8 * x.sum() for k, x in enumerate(own)) and own[0].argmax() != own[1].argmax()


def test_recurrent_beats_the_base_on_unseen_documents(spark):
    """On held-out documents of sf0.1, copies of training documents left out, the model gains on the unigrams."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in recurrent.score(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    learned = {texts[i] for i, r in got.items() if not r["held_out"]}
    fresh = [r for i, r in got.items() if r["held_out"] and texts[i] not in learned]
    n = sum(r["n_tokens"] for r in fresh)
    assert len(fresh) > 50 and sum(r["score"] - r["base_score"] for r in fresh) / n > 0.15


def test_network_learns_from_documents_outside_the_sample(spark):
    """With hardly a sample, the pass over all documents finds that every word tells the next."""
    rows = [(k, " ".join(f"w{(k + i) % 40}" for i in range(60))) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = recurrent.score(docs, sample_docs=1, vocabulary=50, classes=5).collect()
    per_token = {held: np.mean([r["score"] / r["n_tokens"] for r in got if r["held_out"] == held]) for held in (True, False)}
    assert min(per_token.values()) > -0.8


@pytest.mark.parametrize("steep", [0.5, 40.0])
def test_outputs_are_worked_out_class_by_class_in_order(monkeypatch, steep):
    """Rows meet each class's weights as one slice, in blocks that stay in the cache, not picked one by one; values are those of the plain form."""
    rng = np.random.default_rng(5)
    net = recurrent.new_network(rng.integers(1, 50, 90), classes=7, hidden=6, width=4)
    net.to_class[:], net.to_word[:] = rng.normal(0, steep, net.to_class.shape), rng.normal(0, steep, net.to_word.shape)
    states, goals = rng.uniform(-1, 1, (500, 6)).astype(np.float32), rng.integers(0, 90, 500)

    def share(weights, bias, state, goal):
        logits = (state @ weights + bias).astype(np.float64)
        return logits[goal] - logits.max() - np.log(np.exp(logits - logits.max()).sum())

    plain = []
    for state, goal in zip(states, goals, strict=True):
        c = net.class_of[goal]
        a, b = net.starts[c], net.starts[c + 1]
        plain.append(share(net.to_class, net.class_bias, state, c) + share(net.to_word[:, a:b], net.word_bias[a:b], state, goal - a))
    monkeypatch.setattr(recurrent, "LOGIT_ROWS", 64)
    assert np.allclose(net.log_likelihood(states, goals), plain, rtol=1e-4, atol=1e-3)
    grads = {k: np.zeros_like(getattr(net, k)) for k in recurrent.WEIGHTS}
    recurrent._output_gradient(net, states, goals, grads)
    once = {k: np.zeros_like(v) for k, v in grads.items()}
    for i in range(500):
        recurrent._output_gradient(net, states[i : i + 1], goals[i : i + 1], once)
    assert all(np.allclose(grads[k], once[k], rtol=1e-3, atol=1e-2) for k in grads)


def test_words_of_texts_are_those_of_python():
    """Arrow cuts texts at the blanks of ``WORD`` and at no other, and lowers A-Z only."""
    texts = ["", None, " \t\n", " A\x1cB \x85c\xa0D e\x0b\x0cF\r\n\x00 \u00c4Z\u2003z ", "one", "Zz zz\u0085ZZ\tq "]
    words, sizes = recurrent._words(pa.array(texts, pa.string()))
    assert words.to_pylist() == [w for t in texts for w in recurrent.word_list(t, lower=True)]
    assert sizes.tolist() == [len(recurrent.word_list(t)) for t in texts]
    counted = pd.concat([b.to_pandas() for b in recurrent._count(iter([pa.record_batch({"text": pa.array(texts, pa.string())})] * 2))])
    expected = Counter(w.decode() for t in texts for w in recurrent.word_list(t, lower=True))
    assert dict(zip(counted["word"], counted["c"], strict=True)) == {"": 12} | {w: 2 * c for w, c in expected.items()}


def test_a_batch_spells_each_rare_word_once(monkeypatch):
    """Words outside the head are grouped and spelled once for all texts of a batch, not once a text; the texts keep their own counts."""
    words = [b"w%d" % k for k in range(300)]
    tail = recurrent.tail_groups(recurrent.speller(words), [words[k : k + 30] for k in range(0, 300, 10)], words)
    n = tail.profile.shape[1]
    rows = np.concatenate((1 + n + np.arange(100), 1 + tail.groups(words[100:]), [0])).astype(np.int32)
    net = recurrent.new_network(np.ones(1 + n + 100))
    model = recurrent.Model(net, net.gates(), recurrent.Lexicon({w: k for k, w in enumerate(words)}, 100, tail, rows), np.zeros(301), np.zeros(301), 0.0)
    seen, spelled = [], recurrent.Tail.spelled
    monkeypatch.setattr(recurrent.Tail, "spelled", lambda self, words, groups: seen.extend(words) or spelled(self, words, groups))
    batch = pd.DataFrame({"uid": range(40), "doc_id": "1", "held_out": False, "text": [f"w{k} rare Rare other{k % 2}" for k in range(40)]})
    got = pd.concat(recurrent._score_batches(model, iter([batch])))
    assert sorted(seen) == [b"other0", b"other1", b"rare"]
    assert [dict(zip(w, k, strict=True)) for w, k in zip(got["words"], got["ns"], strict=True)] == [{"rare": 2, f"other{k % 2}": 1} for k in range(40)]
    assert (got["n_tokens"] == 5).all() and (got["head_tokens"] == 2).all()


def test_no_task_trains_on_several_shards(spark):
    """Shards are dealt by number; by hash, some tasks got four or five of 64 and others none."""
    segments = spark.range(5000).selectExpr("id / 5000D AS place", "encode(CAST(id AS string), 'utf-8') AS numbers")
    dealt = {(r["shard"], r["part"]) for r in recurrent._dealt(segments, 64).selectExpr("shard", "spark_partition_id() AS part").collect()}
    assert dealt == {(k, k) for k in range(64)}


def test_steep_gates_are_those_of_the_plain_form():
    """Gates far beyond what an exponential holds are 0 or 1, without a warning."""
    import warnings

    rng = np.random.default_rng(3)
    net = recurrent.new_network(np.arange(1.0, 9), classes=2, hidden=5, width=3)
    net.inner[:], net.recur[:] = rng.normal(0, 200, net.inner.shape), rng.normal(0, 20, net.recur.shape)
    state, word_in = rng.uniform(-1, 1, (8, 5)).astype(np.float32), net.gates()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        after = net.step(state, word_in)[0]
        scored = recurrent.score_documents(net, [np.array([3, 5, 7, 2, 0], np.int32)], net.gates())
    z, r = np.split(0.5 * (np.tanh(0.5 * (word_in[:, :10] + state @ net.recur[:, :10]).astype(float)) + 1), 2, axis=1)
    c = np.tanh(word_in[:, 10:] + (r * state) @ net.recur[:, 10:])
    assert np.allclose(after, z * state + (1 - z) * c, atol=1e-4) and np.isfinite(scored).all()
