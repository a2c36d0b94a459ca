"""WARC archives: writing pages as (segmented, chunked) records, and reading them back.

Writing.  Every page becomes an HTTP response record whose body is sent in
chunked transfer framing.  A block longer than ``segment_bytes`` is cut into a
first record and ``continuation`` records that carry the origin's id, their
number and, in the last one, the total length.  Of pages with equal payloads of
at least ``MIN_REVISIT`` bytes, the one with the largest id is a ``response``
and the others are ``revisit`` records that refer to it.  Spark's text writer
lays the records out (its line separator is the blank line that ends a record),
so the committer protects the archives against lost tasks.

Reading.  Each archive file is bounded by ``RECORDS_PER_FILE`` segments, so a
task parses whole files.  Records of one segment are decoded where they are
parsed; only segments travel, grouped by origin id (a group is one page), put in
order of number, checked against the total length, and un-chunked.

Defined results: a null html is an empty payload; equal rows become records of
their own; where several rows share the largest id of a payload all of them are
responses; a null page_id is never referred to, stays a response and is read
back as null; an empty table gives no record; other columns are not looked at;
an html of any length is cut into as many segments as it takes.

Archives may be damaged or of other makers.  A record that can't be decoded or
whose digest or length is wrong is returned with its ``problem``, never dropped.
Where bytes are no record, one row names the ``problem``, and reading goes on at
the next line that starts a record.  A response without this writer's fields is
taken as it is: its length and digest are those of its payload, its page is null.
Records of other types (``warcinfo``, ``request``, ``metadata``, ``resource``,
``conversion``) are no pages and give no row; a continuation whose origin is lost
does.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh_path, materialize, small_batches

MIN_REVISIT = 1000
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
RECORDS_PER_FILE = 1000
OUT_BYTES = 8_000_000
#: No field of a record has this name.
PROBLEM = "\n"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            while body[at : at + 2] != b"\r\n":  # trailer fields
                at = body.find(b"\r\n", at) + 2
                if at < 2:
                    raise ValueError("trailer not ended")
            if at + 2 != len(body):
                raise ValueError("bytes after the last chunk")
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk not ended")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block, decoded if it is chunked."""
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("HTTP head not ended")
    return unchunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the blank line after it, which the writer adds."""
    named = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return VERSION + b"\r\n" + named.encode() + b"\r\n" + block


def page_records(page: str | None, uid: int, url: str | None, payload: bytes, digest: str, refers: str | None, when: str, segment_bytes: int) -> Iterator[bytes]:
    name = "null" if page is None else page
    me = f"<urn:x-page:{name}:{uid}:1>"
    target = "".join(c if " " < c < "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:x-page:{name}"
    common = [("WARC-Date", when), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
    kind = ("Content-Type", "application/http;msgtype=response")
    if refers is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", me), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers}>"), kind], HTTP_HEAD)
        return
    block = HTTP_HEAD + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = [("WARC-Segment-Number", 1)] * (len(parts) > 1)
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", me), *common, kind, *first], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] * (n == len(parts))
        yield _record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:x-page:{name}:{uid}:{n}>"), ("WARC-Date", when), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", n), *total], part
        )


def write_pages(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write ``pages`` as WARC files under ``path``."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), html.alias("payload"), F.sha1(html).alias("digest"))
    repeated = (
        rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.max("page").alias("newest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    repeated = materialize(repeated, "revisits")
    refers = F.when((F.col("page") < F.col("newest")) & (F.octet_length("payload") >= MIN_REVISIT), F.col("newest"))
    joined = rows.join(repeated, "digest", "left").select(
        F.col("page").cast("string"), F.monotonically_increasing_id().alias("uid"), "url", "payload", "digest", refers.cast("string").alias("refers")
    )
    when = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for page, uid, url, payload, digest, refers in zip(*(batch[c] for c in ("page", "uid", "url", "payload", "digest", "refers")), strict=True):
                for record in page_records(page, uid, url, bytes(payload), digest, refers, when, segment_bytes):
                    out.append(record)
                    size += len(record)
                if size > OUT_BYTES:
                    yield pd.DataFrame({"record": out})
                    out, size = [], 0
            yield pd.DataFrame({"record": out})

    records = joined.mapInPandas(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _next_record(data: bytes, at: int) -> int:
    """Where the next line after byte ``at`` that starts a record stands; the end where there is none."""
    found = data.find(b"\nWARC/", at)
    return found + 1 if found >= 0 else len(data)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record of an archive's bytes.

    Bytes that are no record are passed over up to the next record, as an item
    without a block that has ``PROBLEM`` among its fields.
    """
    at = 0
    while at < len(data):
        end = data.find(END, at)
        if not data.startswith(b"WARC/", at) or end < 0:
            yield {PROBLEM: f"no record at byte {at}"}, b""
            at = _next_record(data, at)
            continue
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, length = end + 4, fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            yield fields | {PROBLEM: f"record at byte {at} has no length"}, b""
            at = _next_record(data, at)
            continue
        stop = start + int(length)
        if data[stop : stop + 4] != END:
            yield fields | {PROBLEM: f"record at byte {at} is not ended by a blank line"}, b""
            at = _next_record(data, at)
            continue
        yield fields, data[start:stop]
        at = stop + 4


def checked(block: bytes, digest: str | None, length: int | None) -> tuple[bytes | None, str | None]:
    """(payload, None), or (None, problem); a length or digest that isn't known is not checked."""
    try:
        payload = payload_of(block)
    except ValueError as problem:
        return None, str(problem)
    if length is not None and len(payload) != length:
        return None, f"payload of {len(payload)} bytes instead of {length}"
    if digest is not None and hashlib.sha1(payload).hexdigest() != digest:
        return None, "payload digest differs"
    return payload, None


def _page(urn: str | None) -> str | None:
    """The page that a record id of this writer names."""
    parts = (urn or "").strip("<>").split(":")
    return parts[2] if parts[:2] == ["urn", "x-page"] and len(parts) > 2 and parts[2] != "null" else None


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def _sha1(text: str | None) -> str | None:
    """The SHA-1 of a field in hexadecimal, which archives write in base 32 as well; other digests are not looked at."""
    kind, _, value = (text or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if len(value) == 32:
        with contextlib.suppress(ValueError):
            return base64.b32decode(value.upper()).hex()
    return value.lower()


def read_pages(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per page record: page_id, payload_bytes, payload_digest, record_type, refers_to, problem[, payload]."""

    small_batches(spark)

    def row(fields: dict[str, str], block: bytes) -> tuple | None:
        problem = fields.get(PROBLEM)
        kind, number, me = fields.get("warc-type"), _number(fields.get("warc-segment-number")), fields.get("warc-record-id") or f"lost:{uuid.uuid4().hex}"
        if problem or kind == "continuation" and ("warc-segment-origin-id" not in fields or number is None):
            return me, 0, _page(me), kind, None, None, None, problem or "continuation of nothing", None, -1
        if kind == "continuation":
            return fields["warc-segment-origin-id"], number, None, None, None, None, None, None, block, _number(fields.get("warc-segment-total-length")) or -1
        if kind not in ("response", "revisit"):
            return None
        page, digest, size, refers = _page(me), _sha1(fields.get("warc-payload-digest")), _number(fields.get("x-payload-length")), None
        if kind == "revisit":
            refers, block = _page(fields.get("warc-refers-to")), None
        elif number is None:
            payload, problem = checked(block, digest, size)
            if payload is not None:
                digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
            block = payload if with_payload else None
        return me, number or 0, page, kind, digest, size, refers, problem, block, -1

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out, held = [], 0
                for record in parse(bytes(content)):
                    if (found := row(*record)) is not None:
                        out.append(found)
                        held += len(found[8] or b"")
                    if held > OUT_BYTES:
                        yield pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})
                        out, held = [], 0
                yield pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            payloads, problems, digests, sizes = [], [], [], []
            for parts, total, digest, size, problem in zip(batch["parts"], batch["total"], batch["payload_digest"], batch["payload_bytes"], batch["problem"], strict=True):
                numbers = [p["number"] for p in parts]
                payload = None
                size = None if pd.isna(size) else int(size)
                if numbers == [0]:
                    payload = parts[0]["block"]
                elif numbers != [*range(1, len(parts) + 1)]:
                    problem = f"segments {numbers}"
                else:
                    block = b"".join(bytes(p["block"]) for p in parts)
                    problem = None if len(block) == total else f"{len(block)} bytes in segments instead of {total}"
                    if not problem:
                        payload, problem = checked(block, digest, size)
                    if payload is not None:
                        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                payloads.append(payload)
                problems.append(problem)
                digests.append(digest)
                sizes.append(size)
            batch["problem"] = pd.Series(problems, dtype=object)
            batch["payload_digest"] = pd.Series(digests, dtype=object)
            batch["payload_bytes"] = pd.Series(sizes, dtype="Int64")
            if with_payload:
                batch["payload"] = pd.Series(payloads, dtype=object)
            yield batch.drop(columns=["parts", "total"])

    # ids are strings in the workers: a nullable number would become a float in pandas
    names = ["origin", "number", "page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "problem", "block", "total"]
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInPandas(
        segments, "origin string, number int, page_id string, record_type string, payload_digest string, payload_bytes long, refers_to string, problem string, block binary, total long"
    )
    one = [F.max(c).alias(c) for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem", "total")]
    grouped = parsed.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), *one).drop("origin")
    out = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, problem string" + ", payload binary" * with_payload
    ready = grouped.select("parts", *names[2:8], "total").mapInPandas(joined, out)
    return ready.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` into the shared folder and read the archives back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    return read_pages(pages.sparkSession, path)
