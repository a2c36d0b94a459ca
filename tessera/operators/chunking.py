"""Cutting files into chunks: fixed-size pieces, refinement by lines, overlap, ids, and the global cap.

Sizes are UTF-8 bytes.  Byte-exact cutting follows from where the piece before
ended, so it runs in Python workers, one file at a time; everything else is
expressions.  ``chunk_files`` is the whole operator.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.batches import small_batches
from tessera.functions.text import line_at, line_count
from tessera.operators.structure import split_structure

CHUNK_TYPE = (
    "id string, content string, file_path string, relative_path string, start_line long, end_line long, language string, "
    "metadata struct<file_extension: string, chunk_index: long, hash: string>, ord long"
)


@dataclass(frozen=True)
class Piece:
    """A chunk on its way: its text, lines, number, and the digest of the text before overlap."""

    text: str
    start: int
    end: int
    index: int
    digest: str = ""

    def hashed(self) -> Piece:
        return replace(self, digest=hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).hexdigest())


def lines_of(text: str) -> list[str]:
    """Lines without their ends; an end at the end of the text starts no line, and a return before it goes."""
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
        return [p.removesuffix("\r") for p in parts]
    return [p.removesuffix("\r") for p in parts[:-1]] + parts[-1:]


def _is_boundary(raw: bytes, at: int) -> bool:
    return at >= len(raw) or raw[at] & 0xC0 != 0x80


def fixed_pieces(text: str, size: int, overlap: int, compat_start_line: bool = False) -> list[Piece]:
    """Pieces of at most ``size`` bytes, each starting ``overlap`` bytes before the end of the one before, never inside a character.

    The start line is that of the first character; ``compat_start_line`` counts a
    line cut in the middle as one more, as the original does.
    """
    raw, out, at, newlines = text.encode("utf-8", "surrogatepass"), [], 0, 0
    counted = 0  # bytes whose newlines are counted
    while at < len(raw):
        end = min(at + size, len(raw))
        while end > at and not _is_boundary(raw, end):
            end -= 1
        if end == at:  # one character is larger than a piece
            end = at + 1
            while not _is_boundary(raw, end):
                end += 1
        newlines += raw.count(b"\n", counted, at) if at >= counted else -raw.count(b"\n", at, counted)
        counted = at
        middle = compat_start_line and at > 0 and raw[at - 1] != 0x0A
        piece = raw[at:end].decode("utf-8", "surrogatepass")
        start = newlines + 1 + middle
        out.append(Piece(piece, start, start + max(len(lines_of(piece)), 1) - 1, len(out)).hashed())
        if end >= len(raw):
            break
        if overlap > 0 and end > overlap:
            back = end - overlap
            while not _is_boundary(raw, back):
                back += 1
            at = max(back, at + 1)
            while not _is_boundary(raw, at):
                at += 1
        else:
            at = end
    return out


def refine(text: str, start: int, index: int, size: int) -> list[Piece]:
    """A text over ``size`` bytes as runs of whole lines, trimmed; a single longer line stays whole."""
    lines, out, held, held_bytes, first = lines_of(text), [], [], 0, 0
    for i, line in enumerate(lines):
        full = line if i == len(lines) - 1 else line + "\n"
        n = len(full.encode("utf-8", "surrogatepass"))
        if held and held_bytes + n > size:
            out.append(("".join(held), first, i))
            held, held_bytes, first = [], 0, i
        held.append(full)
        held_bytes += n
    if "".join(held).strip():
        out.append(("".join(held), first, len(lines)))
    return [Piece(t.strip(), start + a, start + b - 1, index * 1000 + k).hashed() for k, (t, a, b) in enumerate(out)]


def overlapped(pieces: list[Piece], overlap: int, separator: str = "\n") -> list[Piece]:
    """Each piece led by the last ``overlap`` bytes of the text before it, as that was without its own lead."""
    if overlap <= 0 or len(pieces) < 2:
        return pieces
    out = pieces[:1]
    for before, now in zip(pieces, pieces[1:], strict=False):
        raw = before.text.encode("utf-8", "surrogatepass")
        at = max(0, len(raw) - overlap)
        while not _is_boundary(raw, at):
            at += 1
        lead = raw[at:].decode("utf-8", "surrogatepass")
        out.append(replace(now, text=f"{lead}{separator}{now.text}", start=max(0, now.start - len(lines_of(lead)))))
    return out


def structural_pieces(text: str, language: str, size: int, overlap: int, separator: str = "\n") -> list[Piece] | None:
    """Syntax nodes as pieces, large ones refined, with overlap; None where the language has no splitter or it fails."""
    found = split_structure(text, language)
    if found is None:
        return None
    if not found:
        found = [(text, 1, max(1, len(lines_of(text))))]
    pieces = []
    for k, (part, start, end) in enumerate(found):
        if len(part.encode("utf-8", "surrogatepass")) > size:
            pieces += refine(part, start, k, size)
        else:
            pieces.append(Piece(part, start, end, k).hashed())
    return overlapped(pieces, overlap, separator) or None


def split_code(text: str, language: str, path: str, size: int = 1000, overlap: int = 200, splitter: str = "ast", compat: bool = False) -> list[tuple[str, Piece]]:
    """(id, piece) of one file.

    Ids hash the path and the lines before overlap; of pieces with equal ids the
    first stays.  Fixed-size pieces add their number to what is hashed, since
    many may share a line.  ``compat`` restores the original's behaviour in
    three places: the overlap separator is a backslash and an n, start lines count
    half lines, and ids of fixed-size pieces have no number.
    """
    if splitter not in ("ast", "langchain"):
        raise ValueError(f"Invalid splitter type '{splitter}'. Must be 'ast' or 'langchain'.")
    pieces = structural_pieces(text, language, size, 0) if splitter == "ast" else None
    named: list[tuple[str, Piece]] = []
    if pieces is None:
        pieces = fixed_pieces(text, size, overlap, compat)
        for p in pieces:
            named.append((chunk_id(path, p.start, p.end, None if compat else p.index), p))
        return named
    led, seen = overlapped(pieces, overlap, "\\n" if compat else "\n"), set()
    for bare, full in zip(pieces, led, strict=True):
        key = chunk_id(path, bare.start, bare.end)
        if key not in seen:
            seen.add(key)
            named.append((key, full))
    return named


def chunk_id(path: str, start: int, end: int, index: int | None = None) -> str:
    tail = "" if index is None else f":{index}"
    return hashlib.sha256(f"{path}:{start}:{end}{tail}".encode("utf-8", "surrogatepass")).hexdigest()


def chunk_files(files: DataFrame, size: int = 1000, overlap: int = 200, splitter: str = "ast", max_bytes: int | None = 1_000_000, compat: bool = False) -> DataFrame:
    """Chunks of ``files`` (path, relative_path, ext, language, content); larger files give none.  ``ord`` is a chunk's place in its file."""
    if splitter not in ("ast", "langchain"):
        raise ValueError(f"Invalid splitter type '{splitter}'. Must be 'ast' or 'langchain'.")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK_TYPE.replace("struct<file_extension: string, chunk_index: long, hash: string>", "x").split(", ")]
        for batch in batches:
            rows = []
            for path, relative, ext, language, content in zip(*(batch[c] for c in ("path", "relative_path", "ext", "language", "content")), strict=True):
                for k, (key, p) in enumerate(split_code(content, language, path, size, overlap, splitter, compat)):
                    rows.append((key, p.text, path, relative, p.start, p.end, language, {"file_extension": ext.removeprefix("."), "chunk_index": p.index, "hash": p.digest}, k))
            yield pd.DataFrame(rows, columns=names)

    small_batches(files.sparkSession)
    small = files.filter(F.col("content").isNotNull())
    if max_bytes is not None:
        small = small.filter(F.octet_length("content") <= max_bytes)
    return small.select("path", "relative_path", "ext", "language", "content").mapInPandas(run, CHUNK_TYPE)


# -- expressions -------------------------------------------------------------


def char_chunks(files: DataFrame, size: int, overlap: int) -> DataFrame:
    """(…, k, content): fixed-size pieces in characters, in closed form, without Python; an empty text gives none."""
    step = size - overlap
    n = F.length("content")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    cut = files.filter(n > 0).select(*files.columns, F.explode(F.sequence(F.lit(0), last)).alias("k"))
    return cut.withColumn("at", (F.col("k") * step).cast("long")).withColumn("piece", F.substr("content", (F.col("at") + 1).cast("int"), F.lit(size)))


def with_lines(pieces: DataFrame) -> DataFrame:
    """start_line and end_line of ``piece`` at character ``at`` of ``content``."""
    start = line_at(F.substr("content", F.lit(1), F.col("at").cast("int")))
    return pieces.withColumn("start_line", start).withColumn("end_line", F.col("start_line") + F.greatest(line_count(F.col("piece")), F.lit(1)) - 1)


def id_of(path: Column, start: Column, end: Column) -> Column:
    return F.sha2(F.concat_ws(":", path, start.cast("string"), end.cast("string")), 256)


def first_of_each_id(chunks: DataFrame, order: str = "ord") -> DataFrame:
    """Of chunks with equal ids the first in order."""
    return chunks.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(order))).filter("n = 1").drop("n")


def previous_tail(content: str, key: str, order: str, overlap: int) -> Column:
    """The last ``overlap`` characters of the row before, in ``order`` within ``key``; null for the first."""
    before = F.lag(content).over(Window.partitionBy(key).orderBy(order))
    return F.substr(before, F.greatest(F.length(before) - overlap + 1, F.lit(1)), F.lit(overlap))


def within_cap(counts: DataFrame, cap: int, splits: int = 256) -> DataFrame:
    """(path, n, before): files in path order whose chunks start below the cap; the file that crosses it is kept.

    The running sum is taken in two steps, within stretches of the order and over
    the stretches' totals.  Stretches are bounded by the ``splits`` paths of smallest
    hash, so they are about equal whatever the paths have in common, and no task
    sorts all files.
    """
    drawn = counts.select("path").orderBy(F.xxhash64("path"), "path").limit(splits)
    bounds = drawn.agg(F.collect_list("path").alias("bounds"))
    keyed = counts.crossJoin(F.broadcast(bounds)).withColumn("head", F.size(F.filter("bounds", lambda b: b <= F.col("path")))).drop("bounds")
    heads = keyed.groupBy("head").agg(F.sum("n").alias("total"))
    upto = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("offset", F.coalesce(F.sum("total").over(upto), F.lit(0))).filter(F.col("offset") < cap)
    inside = Window.partitionBy("head").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(heads.select("head", "offset"), "head").withColumn("before", F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return placed.filter(F.col("before") < cap).select("path", "n", F.col("before").cast("long").alias("before"))
