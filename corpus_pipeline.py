"""The corpus pipeline: five stages over ``documents``, each written and read again.

1. language ID: documents that the identifier rejects go;
2. near-duplicates: of documents linked by a Jaccard similarity of 0.8 the smallest id stays;
3. substring dedup: words of repeated 20-word windows go, and documents that lose all;
4. mixing: documents are repeated or left out so that sources meet their weights;
5. packing: token ids in power-of-two pieces, the last stage's rows.

All stages but the last return the columns of ``documents``, extra ones and
clashing names included.  Each takes (spark, docs, sf_dir); nulls, empty and very
long texts, ties, equal rows and empty tables have the results that the operators'
modules state.  A stage's result has to be written before the next stage is
called, which removes the intermediate tables of the one before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, mixing, packing, simhash, substrings
from tessera.llm.common import discard, materialize, read_paths, recorded, remove, table
from tessera.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles at a Jaccard similarity of 0.8 or more: SimHash and its balls, then MinHash for what no small radius reaches, all verified."""
    return simhash.deduplicate(docs, shingle=5, similarity=0.8)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}


def _tidy(stage: Stage) -> Stage:
    """``stage``, after the tables that the stage before left, but for those that ``docs`` still reads, are removed."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application, reads = spark.sparkContext.applicationId, {p.rpartition("/")[2] for p in read_paths(docs)}
        remove(spark, [p for p in _left.pop(application, []) if p.rpartition("/")[2] not in reads])
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _left[application] = made
        return out

    return run


STAGES = [
    ("language_id", _tidy(identify_language)),
    ("near_duplicates", _tidy(drop_near_duplicates)),
    ("substring_dedup", _tidy(drop_repeated_passages)),
    ("mixing", _tidy(mix_sources)),
    ("packing", _tidy(pack_sequences)),
]

#: Learned models and a tokenizer decide rows, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; every result but the last is written to the shared folder and read again."""
    before = docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
