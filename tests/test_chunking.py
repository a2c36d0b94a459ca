"""Chunking against independent models, by properties and on inputs at the edges."""

import bisect
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import chunking
from tessera.operators.structure import SCANNERS, split_structure

texts = st.text(alphabet="ab é€\U0001f600\n\r", max_size=120)


def model_lines(text):
    """Lines as the original counts them."""
    out = text.split("\n")
    if out and out[-1] == "":
        out = out[:-1]
        return [x[:-1] if x.endswith("\r") else x for x in out]
    return [x[:-1] if x.endswith("\r") and k < len(out) - 1 else x for k, x in enumerate(out)]


def model_spans(text, size, overlap):
    """Byte ranges of the pieces, found among the starts of characters."""
    edges = [0]
    for c in text:
        edges.append(edges[-1] + len(c.encode()))
    total, out, at = edges[-1], [], 0
    while at < total:
        end = max(e for e in edges if e <= at + size)
        if end <= at:
            end = min(e for e in edges if e > at)
        out.append((at, end))
        if end == total:
            break
        at = max(min(e for e in edges if e >= end - overlap), min(e for e in edges if e > at)) if overlap and end > overlap else end
    return out


@given(texts, st.integers(1, 40), st.integers(0, 45))
@settings(max_examples=500, deadline=None)
def test_fixed_pieces_match_the_model(text, size, overlap):
    raw, spans = text.encode(), model_spans(text, size, overlap)
    pieces = chunking.fixed_pieces(text, size, overlap)
    assert [p.text.encode() for p in pieces] == [raw[a:b] for a, b in spans]
    for k, (p, (a, _)) in enumerate(zip(pieces, spans, strict=True)):
        assert p.index == k and p.start == raw[:a].count(b"\n") + 1 and p.end == p.start + max(len(model_lines(p.text)), 1) - 1
        assert p.digest == hashlib.sha256(p.text.encode()).hexdigest()
    if raw:  # nothing is left out
        assert spans[0][0] == 0 and spans[-1][1] == len(raw) and all(b[0] <= a[1] for a, b in zip(spans, spans[1:], strict=False))


@given(texts, st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_lines(text, _):
    assert chunking.lines_of(text) == model_lines(text)


def test_fixed_pieces_edges():
    cut = lambda t, size=10, overlap=3: [p.text for p in chunking.fixed_pieces(t, size, overlap)]
    assert cut("") == [] and cut("abc") == ["abc"] and cut("a" * 10) == ["a" * 10]
    assert cut("abcdefghijk") == ["abcdefghij", "hijk"]
    assert cut("abcdefghié", 10, 3) == ["abcdefghi", "ghié"]  # the cut moves back before a character
    assert cut("\U0001f600\U0001f600", 2, 0) == ["\U0001f600", "\U0001f600"]
    assert cut("ab" * 10, 10, 0) == ["ab" * 5, "ab" * 5]
    long = chunking.fixed_pieces("x" * 5000, 1000, 200)
    assert len(long) == 6 and {(p.start, p.end) for p in long} == {(1, 1)}
    lines = chunking.fixed_pieces("one\r\ntwo\nthree", 8, 0)
    assert [(p.start, p.end) for p in lines] == [(1, 2), (2, 3)]
    assert [(p.start, p.end) for p in chunking.fixed_pieces("one\r\ntwo\nthree", 8, 0, compat_start_line=True)] == [(1, 2), (3, 4)]


def model_refine(text, start, index, size):
    lines, out, held, first = model_lines(text), [], "", 0
    for i, line in enumerate(lines):
        full = line if i == len(lines) - 1 else line + "\n"
        if held and len((held + full).encode()) > size:
            out.append((held, first, i - 1))
            held, first = "", i
        held += full
    if held.strip():
        out.append((held, first, len(lines) - 1))
    return [(t.strip(), start + a, start + b, index * 1000 + k) for k, (t, a, b) in enumerate(out)]


@given(texts, st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_refine_matches_the_model(text, size):
    got = [(p.text, p.start, p.end, p.index) for p in chunking.refine(text, 5, 2, size)]
    assert got == model_refine(text, 5, 2, size)


def test_refine_keeps_long_lines():
    for text in ("x" * 50 + "\na\nb", "a\n" + "x" * 50 + "\nb", "a\nb\n" + "x" * 50):
        assert "x" * 50 in [p.text for p in chunking.refine(text, 1, 0, 10)]


def test_overlap():
    p = [chunking.Piece("aé\nbb", 1, 2, 0, "d0"), chunking.Piece("cc", 5, 5, 1, "d1"), chunking.Piece("dd", 1, 1, 2, "d2")]
    led = chunking.overlapped(p, 4)
    assert [x.text for x in led] == ["aé\nbb", "\nbb\ncc", "cc\ndd"] and [x.digest for x in led] == ["d0", "d1", "d2"]
    assert led[1].start == 3 and led[2].start == 0  # never below zero
    assert chunking.overlapped(p, 0) == p and chunking.overlapped(p[:1], 9) == p[:1]
    assert chunking.overlapped(p, 100)[1].text == "aé\nbb\ncc"


def test_ids_and_dedup():
    code = "class A:\n    def f(self): pass\n"
    named = chunking.split_code(code, "python", "/r/a.py", overlap=0)
    assert named[0][0] == hashlib.sha256(b"/r/a.py:1:2").hexdigest() and named[1][0] == hashlib.sha256(b"/r/a.py:2:2").hexdigest()
    same = chunking.split_code("<a><b>x</b></a>", "xml", "/r/a.xml", overlap=0)
    assert len(same) == 1 and same[0][1].text == "<a><b>x</b></a>"  # all on one line: the outer one stays
    long = chunking.split_code("y" * 3000, "unknown", "/r/a.txt")
    assert len({k for k, _ in long}) == len(long)
    compat = chunking.split_code("y" * 3000, "unknown", "/r/a.txt", compat=True)
    assert len(compat) == 4 and len({k for k, _ in compat}) == 2  # all but the first have equal lines
    assert "\\n" in chunking.split_code("def a(): pass\ndef b(): pass\n", "python", "/p", compat=True)[1][1].text
    with pytest.raises(ValueError):
        chunking.split_code("", "python", "/p", splitter="other")


def test_empty_files():
    assert chunking.split_code("", "unknown", "/p") == []
    assert [p.text for _, p in chunking.split_code("", "python", "/p")] == [""]  # a known language gives one empty chunk


def test_unreadable_structure_falls_back():
    assert split_structure("def broken(:", "python") is None and split_structure('{"a": ', "json") is None and split_structure("x", "cobol") is None
    assert [p.text for _, p in chunking.split_code("def broken(:", "python", "/p")] == ["def broken(:"]


@pytest.mark.parametrize("deep", ["-" * 20_000 + "1", "lorem [" * 5_000])
def test_text_too_deep_for_the_parser_falls_back(deep):
    assert split_structure(deep, "python") is None
    assert "".join(p.text for _, p in chunking.split_code(deep, "python", "/p", size=1000, overlap=0)) == deep


@given(st.text(max_size=200), st.sampled_from(sorted(SCANNERS)))
@settings(max_examples=400, deadline=None)
def test_scanners_never_fail(text, language):
    for part, start, end in split_structure(text, language) or []:
        assert part in text and part.strip() and 1 <= start <= end


CASES = {
    "python": ("@d\ndef f():\n    pass\n\nasync def g():\n    pass\n", ["@d\ndef f():\n    pass", "def f():\n    pass", "async def g():\n    pass"]),
    "json": ('{"a": [1, "]"], "b": {}}', ['{"a": [1, "]"], "b": {}}', '[1, "]"]', "{}"]),
    "rust": ("struct A;\nimpl A {\n  fn f() { let s = \"}\"; }\n}\n", ["struct A;", 'impl A {\n  fn f() { let s = "}"; }\n}', 'fn f() { let s = "}"; }']),
    "go": ("func F() {\n}\ntype T struct {\n}\nvar x = 1\n", ["func F() {\n}", "type T struct {\n}", "var x = 1"]),
    "ruby": ("class A\n  def f\n    if x\n    end\n  end\nend\n", ["class A\n  def f\n    if x\n    end\n  end\nend", "def f\n    if x\n    end\n  end"]),
    "css": ("a { b: c }\n@media x { d { e: f } }", ["a { b: c }", "@media x { d { e: f } }", "d { e: f }"]),
    "toml": ("[a]\nx = 1\n[[b]]\ny = 2\n", ["[a]\nx = 1", "[[b]]\ny = 2"]),
    "yaml": ("a:\n  - 1\n  - {b: 2}\n", ["a:\n  - 1\n  - {b: 2}", "- 1\n  - {b: 2}", "{b: 2}"]),
    "html": ("<p>a<br></p><script>if (a<b) {}</script>", ["<p>a<br></p>", "<br>", "<script>if (a<b) {}</script>"]),
    "markdown": ("# A\nx\n```\n# no\n```\n", ["# A\nx\n```\n# no\n```\n", "# A", "```\n# no\n```"]),
    "java": ("public class A {\n  int f(int x) { return x; }\n}", ["public class A {\n  int f(int x) { return x; }\n}", "int f(int x) { return x; }"]),
    "c": ("int f(int a) {\n  return a;\n}\nint x = 3;\n", ["int f(int a) {\n  return a;\n}", "int x = 3;"]),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_structure(language):
    text, expected = CASES[language]
    if language == "yaml":
        pytest.importorskip("yaml")
    assert [p for p, _, _ in split_structure(text, language)] == expected


def test_cap_keeps_the_file_that_crosses_it(spark):
    rows = [(f"/c/{k % 7}/{k:03d}", 3) for k in range(60)] + [("/a", 2), ("/zz", 9)]
    counts = spark.createDataFrame(rows, "path string, n long")
    before, expected = 0, []
    for path, n in sorted(rows):
        if before < 50:
            expected.append((path, n, before))
        before += n
    got = [tuple(r) for r in chunking.within_cap(counts, 50, splits=4).orderBy("path").collect()]
    assert got == expected
    assert chunking.within_cap(counts.limit(0), 50).count() == 0


def test_cap_deals_paths_out_that_share_a_folder(spark):
    counts = spark.range(4000).selectExpr("format_string('/home/someone/a/long/folder/%05d.py', id) AS path", "1 + id % 3 AS n")
    capped = chunking.within_cap(counts, 3000)
    got = [tuple(r) for r in capped.orderBy("path").collect()]
    assert [r[2] for r in got] == [sum(1 + k % 3 for k in range(i)) for i in range(len(got))] and got[-1][2] < 3000 <= got[-1][1] + got[-1][2]
    drawn = sorted(r["path"] for r in counts.orderBy(F.xxhash64("path"), "path").limit(256).collect())
    sizes = [0] * 257
    for r in counts.collect():
        sizes[bisect.bisect(drawn, r["path"])] += 1
    assert max(sizes) < 4000 // 20


def test_closed_form_equals_bytes_on_ascii(spark):
    files = spark.createDataFrame([(k, "abcdefghij" * k) for k in range(0, 40, 3)], "id int, content string")
    got = {(r["id"], r["k"]): r["piece"] for r in chunking.char_chunks(files, 50, 20).collect()}
    assert got == {(k, p.index): p.text for k in range(0, 40, 3) for p in chunking.fixed_pieces("abcdefghij" * k, 50, 20)}
