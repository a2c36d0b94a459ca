"""WARC, mixing, near-duplicates, neighbours, packing and substring dedup against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests_llm_data import awkward_rows, prose

from tessera.llm import graph, mixing, neighbours, packing, simhash, substrings, warc
from tessera.llm.common import fresh_path
from tessera.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# -- WARC --------------------------------------------------------------------


def page_rows():
    rng = random.Random(4)
    big = "<html>" + "é\r\n\r\nWARC/1.1\r\n" * 9000 + "</html>"
    same = "<p>" + "x" * 1200
    rows = [(1, "http://a", "<p>short</p>"), (2, "http://b", "<p>short</p>"), (3, None, same), (9, "http://c\r\nX: y", same), (5, "u", same), (9, "again", same)]
    rows += [(10, "http://big", big), (11, "http://big2", big), (12, "e", None), (13, "e", ""), (None, "n", same), (None, "n2", "<i>own</i>" * 500), (2**60 + 1, "l", "z" * 999)]
    rows += [(100 + k, "r", "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(rng.randrange(0, 70_000)))) for k in range(12)]
    return rows


def test_warc_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = fresh_path(spark, "test-warc")
    warc.write_pages(pages, path, segment_bytes=5000)
    got = warc.read_pages(spark, path, with_payload=True).collect()
    newest = defaultdict(int)
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            newest[h] = max(newest[h], i)
    expected = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        refers = newest[h] if h in newest and i is not None and i < newest[h] else None
        expected[(i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers, None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["problem"]) for r in got) == expected
    for r in got:
        if r["record_type"] == "response" and r["payload_bytes"] > 5000:
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]


def test_warc_files_are_records(spark):
    path = fresh_path(spark, "test-warc")
    warc.write_pages(spark.createDataFrame([(1, "http://a", "x" * 9000)], "page_id long, url string, html string"), path, segment_bytes=2000)
    records = [x for f in spark.read.format("binaryFile").load(path).collect() for x in warc.parse(bytes(f["content"]))]
    kinds = [f["warc-type"] for f, _ in records]
    assert kinds == ["response", *["continuation"] * (len(records) - 1)] and len(records) > 3
    assert [int(f["warc-segment-number"]) for f, _ in records] == list(range(1, len(records) + 1))
    assert int(records[-1][0]["warc-segment-total-length"]) == sum(len(b) for _, b in records)
    assert warc.payload_of(b"".join(b for _, b in records)) == b"x" * 9000


def test_warc_reports_damage(spark):
    path = fresh_path(spark, "test-warc")
    page = list(warc.page_records("7", 0, "u", b"y" * 5000, hashlib.sha1(b"y" * 5000).hexdigest(), None, "2024-01-01T00:00:00Z", 1000))
    other = list(warc.page_records("8", 0, "u", b"y" * 10, "00", None, "2024-01-01T00:00:00Z", 1000))
    records = page[:1] + page[2:] + other  # a segment is missing, a digest is wrong
    spark.createDataFrame([(b"\r\n\r\n".join(records).decode(),)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    got = {r["page_id"]: r for r in warc.read_pages(spark, path).collect()}
    assert "segments" in got[7]["problem"] and "digest" in got[8]["problem"]


def test_warc_reads_damaged_and_foreign_archives(spark):
    sha = lambda b: hashlib.sha1(b).hexdigest()
    page = lambda n, payload: list(warc.page_records(str(n), 0, "u", payload, sha(payload), None, "2024-01-01T00:00:00Z", 1000))
    record = lambda block, *fields: b"\r\n".join([b"WARC/1.0", *fields, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block
    whole, http = page(1, b"a" * 50)[0], b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    archives = {
        "truncated": [*page(2, b"b" * 300), whole, page(3, b"c" * 300)[0][:-40]],
        "garbage": [b"not a record", whole, b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:4:0:1>\r\nContent-Length: many", page(5, b"e" * 10)[0]],
        "wrong length": [page(6, b"f" * 40)[0].replace(b"Content-Length: ", b"Content-Length: 9"), page(7, b"g" * 9)[0]],
        "foreign": [
            record(b"software: x\r\n", b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:uuid:1>"), record(b"GET / HTTP/1.1\r\n\r\n", b"WARC-Type: request", b"WARC-Record-ID: <urn:uuid:2>"),
            record(http + b"plain", b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:3>", b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"plain").digest())),
            record(b"x", b"WARC-Type: continuation", b"WARC-Record-ID: <urn:uuid:4>"), record(b"no head", b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:5>"),
        ],
    }
    path = fresh_path(spark, "test-warc")
    for name, records in archives.items():
        spark.createDataFrame([(b"\r\n\r\n".join(records).decode(),)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(f"{path}/{name}")
    got = {name: [(r["page_id"], r["record_type"], r["payload_bytes"], r["problem"]) for r in warc.read_pages(spark, f"{path}/{name}").collect()] for name in archives}
    fine = lambda rows: sorted((i, n) for i, _, n, problem in rows if problem is None and i is not None)
    wrong = lambda rows: sorted((i or 0, problem.split(" at byte")[0]) for i, _, _, problem in rows if problem)
    assert fine(got["truncated"]) == [(1, 50), (2, 300)] and wrong(got["truncated"]) == [(3, "record")]
    assert fine(got["garbage"]) == [(1, 50), (5, 10)] and wrong(got["garbage"]) == [(0, "no record"), (4, "record")]
    assert fine(got["wrong length"]) == [(7, 9)] and wrong(got["wrong length"]) == [(6, "record")]
    assert sorted((k, n, p) for _, k, n, p in got["foreign"] if not p) == [("response", 5, None)]
    assert sorted(p for *_, p in got["foreign"] if p) == ["HTTP head not ended", "continuation of nothing"]


def test_chunked_framing():
    for n in (0, 1, 7, 8, 9, 100):
        assert warc.unchunked(warc.chunked(b"a" * n, 8)) == b"a" * n
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: t\r\n\r\n") == b"abc"
    for broken in (b"", b"3\r\nab", b"3\r\nabcd\r\n0\r\n\r\n", b"0\r\n\r\nmore", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def test_warc_empty_and_clashing(spark):
    pages = spark.createDataFrame([(1, "u", "h", "p", "d")], "page_id long, url string, html string, payload string, digest string")
    assert warc.round_trip(pages).count() == 1
    assert warc.round_trip(pages.filter("false")).count() == 0


# -- mixing ------------------------------------------------------------------


def targets_by_rounds(sizes: dict, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left, weight = total - sum(most * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / weight for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing_targets(spark):
    rng = random.Random(8)
    for trial in range(6):
        sizes = {f"s{k}": rng.choice([0, 1, 5, 50, 1000, 20_000]) for k in range(rng.randint(1, 9))} | ({None: 7} if trial % 2 else {})
        sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
        expected = targets_by_rounds(sizes)
        assert got == pytest.approx(expected), sizes


def test_mixing_takes_near_targets(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randint(5, 60)), "abcde"[min(4, int(rng.expovariate(1)))]) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(docs).selectExpr("doc.*", "size", "source_size", "target", "copies").collect()
    taken, target = Counter(), {}
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"])) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.05 * t + 60
    emitted = Counter(r["doc_id"] for r in mixing.mix_documents(docs).collect())
    assert emitted == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})
    again = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs.repartition(7)).selectExpr("doc.doc_id", "copies").collect()}
    assert again == {r["doc_id"]: r["copies"] for r in got}


def test_mixing_awkward(docs, clashing, empty):
    got = mixing.mix_plan(clashing).selectExpr("doc.doc_id AS i", "doc.text AS t", "size", "copies", "target").collect()
    assert len(got) == len(awkward_rows())
    assert all(r["size"] == len(WORD.findall(r["t"] or "")) and r["copies"] is not None for r in got)
    assert len({r["copies"] for r in got if r["i"] == 7}) == 1
    assert mixing.mix_documents(clashing).columns == clashing.columns
    assert mixing.mix_plan(empty).count() == 0
    plan = mixing.mix_plan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


# -- near-duplicates ---------------------------------------------------------


def plain_fingerprint(text, shingle=4):
    import xxhash

    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, radius=4):
    """items: (id, fingerprint) -> smallest id reachable, in order."""
    values = sorted({fp for _, fp in items})
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, v in enumerate(values):
        for w in values[:a]:
            if (v ^ w).bit_count() <= radius:
                parent[find(v)] = find(w)
    least = {}
    for i, fp in items:
        if i is not None:
            least[find(fp)] = min(i, least.get(find(fp), i))
    return [least.get(find(fp)) for _, fp in items]


def test_simhash_components(docs, clashing, empty):
    got = simhash.components(clashing).collect()
    rows = awkward_rows()
    expected = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    comps = plain_components(expected)
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == Counter((i, fp, c) for (i, fp), c in zip(expected, comps, strict=True))
    assert simhash.components(empty).count() == 0


@pytest.mark.parametrize(("blocks", "radius"), [(1, 2), (2, 4), (2, 3), (4, 4)])
def test_links_lose_nothing(spark, blocks, radius):
    rng = random.Random(blocks * 10 + radius)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = set(centres)
    for c in centres:
        for _ in range(12):
            values.add(c ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 5))}))
    values |= {centres[0] ^ (1 << b) for b in range(40)}  # one large run
    signed = [v - 2**64 if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, blocks)
    roots = {r["node"]: r["root"] for r in graph.connected_components(found).collect()}
    items = [(k, v) for k, v in enumerate(sorted(values))]
    expected = plain_components(items, radius)
    mine = defaultdict(set)
    for k, v in items:
        s = v - 2**64 if v >> 63 else v
        mine[roots.get(s, s)].add(k)
    theirs = defaultdict(set)
    for (k, _), c in zip(items, expected, strict=True):
        theirs[c].add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_variants_are_half_the_radius():
    assert len(simhash.variant_masks(1, 4)) == 1 + 64 + 64 * 63 // 2
    assert len(simhash.variant_masks(2, 4)) == 2 * 33


def test_simhash_deduplicate(clashing, empty):
    rows = awkward_rows()
    comps = plain_components([(i, plain_fingerprint(t)) for i, t, *_ in rows])
    kept = simhash.deduplicate(clashing)
    assert kept.columns == clashing.columns
    expected = Counter({i for (i, *_), c in zip(rows, comps, strict=True) if i is not None and i == c})
    expected[None] = sum(i is None for i, *_ in rows)
    assert Counter(r["doc_id"] for r in kept.collect()) == expected
    assert simhash.deduplicate(empty).count() == 0


def test_simhash_deduplicate_repeated_ids(spark):
    """Unlike texts of one id each stand for their component; a near copy doesn't stay for its id's sake."""
    rng = random.Random(6)
    one, two, three, four = (prose(rng, 80) for _ in range(4))
    rows = spark.createDataFrame([(1, one), (2, one), (2, two), (3, three), (3, four)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.deduplicate(rows).collect())) == sorted([(1, one), (2, two), (3, three), (3, four)])


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_star_with_half_of_all_edges(spark):
    """One node has half of the edges, at either end of them; the rest are pairs."""
    rows = [(10_000, k) if k % 2 else (k, 10_000) for k in range(20_000, 23_000)] + [(k, k + 1) for k in range(0, 6000, 2)]
    edges = spark.createDataFrame(rows, "a long, b long").repartition(6)
    got = {r["node"]: r["root"] for r in graph.connected_components(edges).collect()}
    assert got == {k: 10_000 for k in [10_000, *range(20_000, 23_000)]} | {k: k - k % 2 for k in range(6000)}


# -- neighbours --------------------------------------------------------------


def vector_rows(n=1500, dim=16):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, dim))
    x = (centres[rng.integers(12, size=n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)
    x[100:400] = x[100]  # a third of some part are copies
    rows = [(k, [float(v) for v in x[k]]) for k in range(n)]
    nothing = [(2000, None), (2020, []), (2040, [0.0] * dim), (2060, [float("nan")] * dim), (2080, [float("inf")] + [1.0] * (dim - 1)), (2100, [None] + [1.0] * (dim - 1)), (2120, [1.0] * 3), (None, [1.0] * dim)]
    return rows + rows[5:7], nothing


def test_neighbours(spark):
    rows, nothing = vector_rows()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows + nothing], "vec_id long, embedding array<float>, part string, q int")
    got = defaultdict(list)
    for r in neighbours.search(table, "vec_id % 20 = 0", 20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    own = dict(rows)
    ids = np.array(sorted(own))
    x = np.array([own[i] for i in ids], np.float64)
    assert set(got) == {i for i in own if i % 20 == 0}
    hits = total = 0
    for q, found in got.items():
        found.sort()
        exact = (np.array(own[q]) * x).sum(1)
        assert [r for r, *_ in found] == list(range(1, 21)) and q not in [i for _, i, _ in found]
        for _, i, s in found:
            assert s == pytest.approx(float(np.dot(np.array(own[q]), np.array(own[i]))), rel=1e-12)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        order = sorted((-s, i) for s, i in zip(exact, ids, strict=True) if i != q)[:20]
        hits += len({i for _, i, _ in found} & {i for _, i in order})
        total += 20
    assert hits / total >= 0.9


def test_rank_block_ties():
    x = np.array([[1.0, 0]] * 50 + [[0.5, 1]] * 5)
    ids = np.arange(55)[::-1]
    got = neighbours.rank_block(np.array([10, 99]), np.array([[1.0, 0], [1.0, 0]]), ids, x, 3)
    assert got[got.query_id == 10]["vec_id"].tolist() == [5, 6, 7] and got[got.query_id == 99]["vec_id"].tolist() == [5, 6, 7]
    got = neighbours.rank_block(np.array([5]), np.array([[1.0, 0]]), ids, x, 3)
    assert got["vec_id"].tolist() == [6, 7, 8]


def test_neighbours_small_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(few, "vec_id % 20 = 0", 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert neighbours.search(few.filter("false"), "vec_id % 20 = 0", 20).count() == 0
    assert neighbours.search(few.filter("vec_id = 1"), "vec_id % 20 = 0", 20).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(640, 8)).astype(np.float32)
    sizes = np.bincount(neighbours.balanced_parts(neighbours.neighbour_graph(x), 8), minlength=8)
    assert sizes.tolist() == [80] * 8
    first, split = neighbours.lay_out({0: 10, 1: 95, 2: 250, 3: 5, 4: 5}, 100)
    blocks = [first[p] + k for p in first for k in range(split[p])]
    assert split[2] == 3 and first[3] == first[4] and len(set(blocks)) == 6


# -- packing -----------------------------------------------------------------


def test_pieces_are_powers_of_two():
    for n in (1, 2, 3, 1023, 1024, 1025, 5000):
        got = list(packing.pieces(n))
        assert all(length & (length - 1) == 0 and length <= 1024 for _, length in got)
        assert [a for a, _ in got] == list(np.cumsum([0] + [length for _, length in got])[:-1]) and sum(length for _, length in got) == n
        assert [length for _, length in got] == sorted((length for _, length in got), reverse=True)


def test_packing_round_trip(docs, clashing, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(clashing, tokenizer_path(), with_ids=True).collect()
    assert len({(r["sequence_id"]) for r in got}) == len(got) and all(r["offset"] == 0 for r in got)
    texts = defaultdict(list)
    for i, t, *_ in awkward_rows():
        texts[i].append(t)
    pieces = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], ids.tolist(), r["doc_tokens"]))
    for i, own in texts.items():
        expected = Counter()
        for t in own:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
            expected.update((a, tuple(ids[a : a + n]), len(ids)) for a, n in packing.pieces(len(ids)))
        assert Counter((a, tuple(ids), n) for a, ids, n in pieces[i]) == expected
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    encode, tokenizer = packing.Encoder(spec), Tokenizer.from_str(spec)
    assert encode.fast is not None
    for text in ["a b  c\n\n d\x1c\x85x  ", " 　foo 'll I'LL", "\x00é① ٣", "a<|endoftext|>b", "x" * 5000, "don't 'd\n've\t\t y", awkward_rows()[5][1]]:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# -- substring dedup ---------------------------------------------------------


def plain_substrings(rows, window=20):
    """Per row: kept words. Rows of one id are one document as far as order goes."""
    order = lambda i: (-1, 0) if i is None else (0, i)
    first = {}
    for i, t in rows:
        words = WORD.findall(t or "")
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, (order(i), k)), (order(i), k))
    out = []
    for i, t in rows:
        words = WORD.findall(t or "")
        gone = np.zeros(len(words), bool)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] != (order(i), k):
                gone[k : k + window] = True
        out.append((i, len(words), int(gone.sum()), [w for w, g in zip(words, gone, strict=True) if not g]))
    return out


def passage_rows():
    rng = random.Random(12)
    passages = [prose(rng, n) for n in (19, 20, 21, 25, 40, 90)]
    rows = []
    for k in range(150):
        parts = [prose(rng, rng.randint(0, 30)) for _ in range(3)]
        for p in rng.sample(passages, rng.randint(0, 2)):
            words = p.split()
            cut = rng.randint(0, 5)
            parts.insert(rng.randint(0, 3), " ".join(words[cut : len(words) - rng.randint(0, 5)]))
        rows.append((k, " ".join(parts)))
    rows += [(200, "a " * 100), (201, "a b " * 60), (202, "a " * 19), (203, "a " * 20)]
    return rows


def digest(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


@pytest.mark.parametrize("source", ["passages", "awkward", "hot"])
def test_substrings(spark, clashing, source, monkeypatch):
    if source == "hot":  # every document is in the sample, and what stands twice is frequent
        monkeypatch.setattr(substrings, "HOT_SHARE", 1)
        monkeypatch.setattr(substrings, "HOT_LEAST", 2)
    if source != "awkward":
        rows = passage_rows()
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    else:
        rows, docs = [(i, t) for i, t, *_ in awkward_rows()], clashing
    expected = Counter((i, n, gone, digest(kept)) for i, n, gone, kept in plain_substrings(rows))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digests(docs).collect())
    assert got == expected


def test_matches_of_equal_rows_count_once(spark):
    """2,000 equal rows of one document carry the matches of a few."""
    text = " ".join(f"w{k}" for k in range(60))
    found = {}
    for k in (20, 2000):
        docs = spark.createDataFrame([(1, text)] + [(5, text)] * k, "doc_id long, text string").repartition(4)
        rows = substrings.marked(substrings._keyed(docs, "doc_id", "text")).filter("doc = 5").selectExpr("size(matches) AS n").collect()
        assert len(rows) == k
        found[k] = max(r["n"] for r in rows)
    assert found[2000] <= found[20] + 2 <= 130
    digests = {(r["doc_id"], r["n_removed"]) for r in substrings.digests(docs).collect()}
    assert digests == {(1, 0), (5, 60)}


def test_substrings_deduplicate(clashing, empty):
    rows = awkward_rows()
    expected = Counter()
    for (i, _, gone, kept), (_, text, *_) in zip(plain_substrings([(i, t) for i, t, *_ in rows]), rows, strict=True):
        if gone == 0:
            expected[(i, text)] += 1
        elif kept:
            expected[(i, " ".join(kept))] += 1
    out = substrings.deduplicate(clashing)
    assert out.columns == clashing.columns and out.dtypes == clashing.dtypes
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == expected
    assert substrings.deduplicate(empty).count() == 0 and substrings.digests(empty).count() == 0


def test_long_runs_are_searched_by_balls():
    """6,000 values that share a half, clustered and not: the same components as by the search over all, in linear time."""
    import time

    rng = np.random.default_rng(3)
    far = rng.integers(0, 1 << 32, 5000, np.uint64)
    near = rng.choice(far[:40], 1000) ^ (np.uint64(1) << rng.integers(0, 32, 1000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 32, 1000).astype(np.uint64))
    values = np.unique(np.concatenate((far, near)) | (np.uint64(7) << np.uint64(40)) | (rng.integers(0, 2, 6000).astype(np.uint64) << np.uint64(33)))

    def components(edges) -> dict[int, int]:
        root = list(range(len(values)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in edges:
            assert int(values[a] ^ values[b]).bit_count() <= 4
            a, b = sorted((top(a), top(b)))
            root[b] = a
        return {k: top(k) for k in range(len(values))}

    assert components(simhash._forest_by_balls(values, 4)) == components(simhash._forest(values, 4))
    many = np.unique(rng.integers(0, 1 << 32, 60_000, np.uint64))
    began = time.perf_counter()
    simhash._forest_by_balls(many, 4)
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("held", [50_000, 3])
def test_substrings_factors_are_copies(spark, held, monkeypatch):
    """Every factor is a copy of what stands at its source, which is earlier; factors don't overlap, and hold what brute force removes."""
    monkeypatch.setattr(substrings, "HEADS", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # workers meet copies in many batches
    try:
        rows = passage_rows() + [(300 + k, " ".join([prose(random.Random(k), 10), PASSAGE, prose(random.Random(-k - 1), 10)])) for k in range(120)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got, words, gone = defaultdict(list), {i: WORD.findall(t) for i, t in rows}, {}
        for r in substrings.factors(docs).collect():
            got[r["doc_id"]].append((r["start"], r["length"], r["source_doc"], r["source_start"]))
        for i, own in got.items():
            end, covered = 0, set()
            for start, length, doc, at in sorted(own):
                assert start >= end and (doc, at) < (i, start) and words[doc][at : at + length] == words[i][start : start + length]
                end = start + length
                covered |= set(range(start, end))
            gone[i] = len(covered)
        assert {i: n for i, _, n, _ in plain_substrings(rows) if n} == gone
        assert any(length > 60 for own in got.values() for _, length, *_ in own)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


PASSAGE = prose(random.Random(77), 70)


def test_parse_takes_the_match_that_reaches_furthest():
    match = lambda first, last, doc, at: {"span": (first << 32) | last, "doc": doc, "at": at}
    assert substrings.parse([]) == [] and substrings.parse(None) == []
    assert substrings.parse([match(0, 3, 1, 7), match(4, 9, 1, 11)]) == [(0, 29, 1, 7)]
    assert substrings.parse([match(0, 3, 1, 7), match(2, 30, 2, 5), match(10, 12, 3, 0)]) == [(0, 23, 1, 7), (23, 27, 2, 26)]
    assert substrings.parse([match(0, 0, 1, 0), match(50, 50, 1, 0)]) == [(0, 20, 1, 0), (50, 20, 1, 0)]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 100).astype(np.uint64) for _ in range(2))
    b[30:70] = a[10:50]
    places_a, places_b = substrings.anchors(a), substrings.anchors(b)
    for k in range(10, 31):
        assert places_a[k] - k == places_b[k + 20] - (k + 20)
