"""Packing by power-of-two decomposition.

A document's token ids, an end id after them, are cut into pieces whose lengths
are powers of two: as many of the full length as fit, then the binary digits of
the rest, largest first.  Pieces of equal length form a bucket, so a batch is a
rectangle without padding and no sequence crosses documents: a piece is a
sequence.  Every task lays its pieces out by bucket, so equal lengths lie together
in each file; no row is ever shuffled.

Tokens come from a tokenizer file of the ``tokenizers`` library.

Defined results: a null or empty text is the end id alone; a text of any length is
packed whole; equal rows are packed independently of each other, and pieces of
equal length lie in the order of their documents and places; an empty table gives an empty result; other
columns are not looked at.  Strings of special tokens in a text are encoded as
the tokenizer file has it by default.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches

FULL = 1024
END_ID = 0
#: Fixed value: the part pattern of byte-level BPE with its default pre-tokenizer.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    """Text to a numpy array of ids; made once in each Python worker from the tokenizer's JSON.

    A plain byte-level BPE whose merges are ranked as its ids goes through the
    faster of the two public libraries, which gives the same ids; any other
    file, and a text that holds a special token's string, through the first.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        pre, model = parsed.get("pre_tokenizer") or {}, parsed.get("model") or {}
        self.special = [t["content"] for t in parsed.get("added_tokens") or ()]
        self.tokenizer, self.fast = Tokenizer.from_str(spec), None
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if plain and parsed.get("normalizer") is None and model.get("type", "BPE") == "BPE" and not model.get("ignore_merges"):
            vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
            merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
            if merged == sorted(merged) and len(merged) + 256 == len(vocab):
                import tiktoken

                byte_of = _byte_of()
                ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
                self.fast = tiktoken.Encoding("byte-level", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def pieces(n: int, full: int = FULL) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, then n's binary digits."""
    at = 0
    while n - at >= full:
        yield at, full
        at += full
    size = full >> 1
    while size:
        if (n - at) & size:
            yield at, size
            at += size
        size >>= 1


def pack(docs: DataFrame, tokenizer_path: str, full: int = FULL, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket[, ids].

    ``tokenizer_path`` is read on the driver; its contents travel with the task.
    ``full`` is a power of two.  ``bucket`` is the piece's length: writing the
    result with ``partitionBy("bucket")`` lays the buckets out.
    """
    if full < 1 or full & (full - 1):
        raise ValueError("full must be a power of two")
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = END_ID.to_bytes(4, "little")
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(spec.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                ids = (encode(text).tobytes() if text else b"") + end
                n = len(ids) // 4
                for start, length in pieces(n, full):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(part), n, *([part] if with_ids else [])))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    # ids travel as strings: a nullable number would become a float in pandas
    packed = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).mapInPandas(run, schema)
    packed = packed.withColumn("doc_id", F.col("doc_id").cast(id_type)).sortWithinPartitions("length", "doc_id", "start")
    return packed.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.col("length")})
