"""The jobs as named queries: each runs twice into one new folder, and the whole output is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import build_index, ingest_chunks
from tessera.functions.text import MAX_TOKEN_BYTES
from tessera.operators.bm25 import K1, B
from tessera.plans.queries import BYTES_SQL
from tessera.sources.places import fresh_folder


def job1_build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings by (bucket, term, block); contributions in millionths, ids and contributions as text."""
    target = fresh_folder(spark, "job1")
    for _ in range(2):
        build_index.run(spark, f"{sf_dir}/documents.parquet", target)
    # contributions are positive, so half of them up is what ROUND does; it goes through decimals
    millionths = lambda x: F.floor(x * 1_000_000 + 0.5)
    as_text = lambda c: F.array_join(c.cast("array<string>"), " ")
    found = build_index.read(spark, target)
    return found.select("bucket", "term", "block", "df", "docs", millionths(F.col("top")).alias("top"), as_text(F.col("ids")).alias("ids"), as_text(F.transform("parts", millionths)).alias("parts"))


JOB1_SQL = f"""
WITH split AS (
  SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) <= {MAX_TOKEN_BYTES}) AS w FROM documents WHERE doc_id IS NOT NULL
), sized AS (
  SELECT id, w, len(w)::BIGINT AS dl, bin(len(w)::BIGINT) AS digits FROM split
), classed AS (
  SELECT id, w, dl, lpad(length(digits)::VARCHAR, 2, '0') || '-' || substring(digits, 2, 2) AS class FROM sized
), shards AS (
  SELECT class, ceil(count(*) / 128)::BIGINT AS shards FROM classed GROUP BY class
), stats AS (
  SELECT count(*) AS n, avg(dl) AS avgdl FROM classed
), tf AS (
  SELECT id, dl, class, term, count(*) AS tf FROM (SELECT id, dl, class, unnest(w) AS term FROM classed) GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), parts AS (
  SELECT term, class || '-' || (('0x' || substring(md5(id::VARCHAR), 1, 8))::BIGINT % shards)::VARCHAR AS block, df, id,
    round(1000000 * ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * {K1 + 1}e0 / (tf + {K1}e0 * ({1 - B}e0 + {B}e0 * dl / avgdl))))::BIGINT AS part
  FROM tf JOIN shards USING (class) JOIN df USING (term), stats
)
SELECT (('0x' || substring(md5(term), 1, 4))::BIGINT % 16)::INTEGER AS bucket, term, block, df, count(*) AS docs, max(part) AS top,
  string_agg(id::VARCHAR, ' ' ORDER BY id) AS ids, string_agg(part::VARCHAR, ' ' ORDER BY id) AS parts
FROM parts GROUP BY term, block, df
"""


def job2_ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that hold after two runs, the second of which finds nothing new."""
    target = fresh_folder(spark, "job2")
    for _ in range(2):
        ingest_chunks.run(spark, f"{sf_dir}/documents.parquet", f"{target}/chunks", f"{target}/checkpoint")
    found = ingest_chunks.read(spark, f"{target}/chunks")
    return found.select("id", "relative_path", "start_line", "end_line", "language", "ord", "content", "metadata.hash")


JOB2_SQL = (
    f"WITH {BYTES_SQL} SELECT sha256(path || ':' || start_line::VARCHAR || ':' || end_line::VARCHAR || ':' || k::VARCHAR) AS id, relative_path, start_line, end_line, "
    "CASE ext WHEN '.md' THEN 'markdown' WHEN '.rs' THEN 'rust' WHEN '.py' THEN 'python' ELSE 'unknown' END AS language, k AS ord, piece AS content, sha256(piece) AS hash FROM ended"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_build_index": job1_build_index, "job2_ingest_chunks": job2_ingest_chunks}
ORACLES = {"job1_build_index": JOB1_SQL, "job2_ingest_chunks": JOB2_SQL}
