"""Text expressions: tokens, lines, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
MAX_TOKEN_BYTES = 39


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, very long ones left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: F.octet_length(t) <= MAX_TOKEN_BYTES)


def line_count(text: Column) -> Column:
    """Number of lines; a line end at the end adds none."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (ends + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)).cast("long")


def line_at(text_before: Column) -> Column:
    """1-based number of the line on which the text after ``text_before`` starts."""
    return (F.length(text_before) - F.length(F.replace(text_before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def embedding_input(text: Column, max_tokens: int = 8192) -> Column:
    """What is sent to an embedder: a space for nothing, and the first 4 * max_tokens characters of a text of more bytes."""
    most = 4 * max_tokens
    return F.when(text == "", F.lit(" ")).when(F.octet_length(text) > most, F.substring(text, 1, most)).otherwise(text)
