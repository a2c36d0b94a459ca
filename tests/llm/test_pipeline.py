"""The pipeline's stages, and the registered queries."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests_llm_data import awkward_rows

import __spark_entry__
from tessera.llm import queries


def run_stages(spark, docs):
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}-{id(out)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    return docs, counts


def test_stages(spark, docs):
    packed, counts = run_stages(spark, docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "mixing", "packing"]
    assert counts[0] == len(awkward_rows()) and counts[1] < counts[0] and counts[2] < counts[1]
    whole = packed.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))
    assert whole.filter(F.col("n") % F.col("doc_tokens") != 0).count() == 0


def test_stages_take_empty_tables_and_extra_columns(spark, empty, clashing):
    assert run_stages(spark, empty)[1] == [0] * 6
    assert run_stages(spark, clashing.limit(20))[1][0] == 20


def test_shared_folder(spark):
    from types import SimpleNamespace

    from tessera.llm import common

    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    unset = SimpleNamespace(get=lambda key, default=None: default)
    session = lambda master: SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))
    own = common.shared_dir(session("local[2]"))
    assert own == common.shared_dir(session("local[2]")) and own.rsplit("/", 1)[1].startswith("tessera-")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))


def test_tables_can_be_cleared(spark):
    from tessera.llm import common

    kept = common.materialize(spark.range(5).selectExpr("id AS a"), "mine")
    assert kept.count() == 5
    gone = common.materialize(spark.range(3).selectExpr("id AS a"), "other")
    common.discard(gone)
    assert common.materialize(spark.range(0).selectExpr("id AS a"), "none").count() == 0
    assert common.clear(spark) >= 2 and common.clear(spark) == 0


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 13)] == [1] * 12
    assert "pipeline" in names and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, found.fetchall()))


def plain_pipeline(spark, docs):
    """The five stages by brute force, but for the trained model, which is the pipeline's own."""
    import hashlib
    import zlib
    from collections import Counter

    from test_corpus_operators import WORD, plain_components, plain_fingerprint, plain_substrings, targets_by_rounds
    from tokenizers import Tokenizer

    from tessera.llm import langid, mixing, packing

    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    model = langid.fit(docs)
    rows = [r for r in rows if not model.judge(r[1])[2]]
    comps = plain_components([(i, plain_fingerprint(t, 5)) for i, t, _ in rows])
    seen, kept = set(), []
    for (i, t, s), c in zip(rows, comps, strict=True):
        if i is None or (i == c and i not in seen):
            seen.add(i)
            kept.append((i, t, s))
    rows = []
    for (i, t, s), (_, _, gone, words) in zip(kept, plain_substrings([(i, t) for i, t, _ in kept]), strict=True):
        if not gone or words:
            rows.append((i, " ".join(words) if gone else t, s))
    sizes = Counter({s: 0 for *_, s in rows})
    hashed = []
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
        inner = hashlib.md5((t or "").encode()).hexdigest()
        key = inner if i is None else f"{i}:{inner}"
        hashed.append(int(hashlib.md5(key.encode()).hexdigest()[:8], 16))
    target = targets_by_rounds(sizes)
    copies = {}
    for s in sizes:
        own = [(k, len(WORD.findall(rows[k][1] or ""))) for k in range(len(rows)) if rows[k][2] == s]
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        best = None
        for turn in range(mixing.ROTATIONS):
            got = {k: int(rate) + int((hashed[k] + turn * (2**32 // mixing.ROTATIONS)) % 2**32 / 2.0**32 < rate - int(rate)) for k, _ in own}
            off = abs(sum(got[k] * n for k, n in own) - target[s])
            if best is None or off < best[0]:
                best = (off, got)
        copies |= best[1]
    tokenizer, out = Tokenizer.from_file(queries.tokenizer_path()), Counter()
    for k, (i, t, _) in enumerate(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for a, n in packing.pieces(len(ids)):
            raw = b"".join(x.to_bytes(4, "little") for x in ids[a : a + n])
            out[(i, a, n, zlib.crc32(raw), len(ids))] += copies[k]
    return +out


def test_stages_match_brute_force(spark, docs):
    from collections import Counter

    got = run_stages(spark, docs)[0].select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert Counter(map(tuple, got)) == plain_pipeline(spark, docs)


def test_run_over_a_folder(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    packed = out.collect()
    assert packed and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    assert len({r["sequence_id"] for r in packed}) == len(packed)


def test_near_duplicates_in_a_crowd(spark):
    """One group is half of all rows, many of its pairs just miss the bar: the components are those of brute force."""
    import random

    from tests_llm_data import prose

    from tessera.llm.resemblance import deduplicate, jaccard, shingle_set

    rng, rows = random.Random(21), []
    base = prose(rng, 120).split()
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(0, 120, 5), rng.choice([1, 2, 3, 4, 6, 8])):
            words[at] = f"new{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, prose(rng, 60)) for k in range(150)]
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(150):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    kept = sorted(rows[i][0] for i in range(len(rows)) if top(i) == i)
    assert 160 < len(kept) < 290
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(r["doc_id"] for r in got) == kept


@pytest.mark.parametrize("block", [4096, 7])
def test_near_duplicates_at_the_stages_bar(spark, block, monkeypatch):
    """Every pair just above Jaccard 0.8 is found, none just below; 40 like texts make runs that aren't small."""
    from tessera.llm import resemblance

    monkeypatch.setattr(resemblance, "BLOCK", block)
    import random

    from tests_llm_data import DOC_TYPE, prose

    from tessera.llm.resemblance import jaccard, shingle_set

    rng, rows, loses = random.Random(8), [], set()
    for k in range(60):
        words = prose(rng, 150).split()
        changed = [*words[: len(words) - (14 if k % 2 else 19)], *prose(rng, 14 if k % 2 else 19).split()]
        one, other = " ".join(words), " ".join(changed)
        assert (jaccard(shingle_set(one), shingle_set(other)) >= 0.8) == (k % 2 == 1)
        rows += [(2 * k, one, "en", "a", 0), (2 * k + 1, other, "en", "a", 0)]
        loses |= {2 * k + 1} if k % 2 else set()
    base = prose(rng, 200).split()
    for k in range(40):
        words = list(base)
        words[5 * k] = f"other{k}"
        rows.append((1000 + k, " ".join(words), "en", "a", 0))
        loses |= {1000 + k} if k else set()
    # same id, unlike texts: each stands for its own component; a near copy doesn't stay for its id's sake
    rows += [(2000, prose(rng, 80), "en", "a", 0), (2000, prose(rng, 80), "en", "a", 0), (2001, rows[0][1] + " more", "en", "a", 0), (2001, prose(rng, 80), "en", "a", 0)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOC_TYPE).repartition(4), "").collect()
    expected = sorted([(r[0], r[1]) for r in rows if r[0] not in loses and r[:2] != (2001, rows[0][1] + " more")])
    assert sorted((r["doc_id"], r["text"]) for r in kept) == expected


def test_near_duplicates_go_through_ball_hashing(spark, monkeypatch):
    """The stage takes the SimHash operator's links as candidates, beside MinHash's; texts that are not as similar stay."""
    import corpus_pipeline
    from tessera.llm import resemblance, simhash

    words = [f"w{k * 7919 % 5000}" for k in range(400)]
    changed = [*words[:200], "other", *words[201:]]
    rows = [(3, " ".join(words)), (5, " ".join(changed)), (8, " ".join(words[::-1])), (9, " ".join(words).upper()), (11, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    links, seen = simhash.links, []
    monkeypatch.setattr(simhash, "links", lambda *given: seen.append(links(*given)) or seen[-1])
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == [3, 8, 11] and len(seen) == 1
    distinct = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, 0x7777), (-5, 0x7776)], "key long, fp long")
    assert {tuple(r) for r in resemblance._ball_pairs(distinct, links(distinct.select("fp").distinct())).collect()} == {(1, 2), (1, 3), (-5, 4)}


def test_ball_pairs_join_unlike_components_only(spark):
    """A crowd's links of fingerprints are not verified on the texts where the crowd is one component already."""
    from tessera.llm import resemblance, simhash

    distinct = spark.createDataFrame([(k, 0x1000 + k) for k in range(16)] + [(50, 0x1000), (60, 0x1001)], "key long, fp long")
    roots = spark.createDataFrame([(k, 0) for k in range(16)] + [(60, 0)], "key long, root long")
    links = simhash.links(distinct.select("fp").distinct())
    assert resemblance._ball_pairs(distinct, links).count() > 16
    assert {tuple(r) for r in resemblance._ball_pairs(distinct, links, roots).collect()} == {(0, 50)}


def test_components_after_more_links(spark):
    from tessera.llm import resemblance

    roots = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "key long, root long")
    links = lambda *rows: spark.createDataFrame(list(rows), "a long, b long")
    found = {tuple(r) for r in resemblance._joined(roots, links((2, 6), (-3, 9), (20, 21), (1, 2))).collect()}
    assert found == {(1, 1), (2, 1), (5, 1), (6, 1), (8, -3), (9, -3), (-3, -3), (20, 20), (21, 20)}
    assert {tuple(r) for r in resemblance._joined(roots, links()).collect()} == {tuple(r) for r in roots.collect()}
