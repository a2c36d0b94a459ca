"""The queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import conversations, langid, mixing, neighbours, outliers, packing, quality, recurrent, simhash, sql, substrings, toxicity, warc
from tessera.llm.common import crc_mod, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.classify(docs, labels).withColumn("held_out", crc_mod("doc_id", 3) == 1)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP2_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), newest AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN newest END AS refers_to,
  CAST(NULL AS VARCHAR) AS problem
FROM newest
"""


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sizes(docs).selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


OP3_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substring(md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 8))::BIGINT AS hashed
  FROM documents
), placed AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (ARRAY[5e0, 2e0, 1e0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), listed AS (
  SELECT *, source_size::DOUBLE * 3 AS cap, source_size::DOUBLE * 3 / weight AS overflow FROM placed
), leveled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY overflow, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / sum(weight) OVER (ORDER BY overflow, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM listed
), targets AS (
  SELECT source, source_size,
    least(cap, max(CASE WHEN level <= overflow THEN level END) OVER () * weight) AS target FROM leveled
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate FROM targets
), turned AS (
  SELECT r.source, r.target, k, sum(d.size * (floor(r.rate)
      + CASE WHEN ((d.hashed + k * 134217728) % 4294967296)::DOUBLE / 4294967296e0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END)) AS got
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN range(32) t(k)
  GROUP BY r.source, r.target, k
), chosen AS (
  SELECT source, k FROM (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY abs(got - target), k) AS n FROM turned) WHERE n = 1
)
SELECT d.doc_id, d.size, r.source_size, r.target,
  (d.size * (floor(r.rate) + CASE WHEN ((d.hashed + c.k * 134217728) % 4294967296)::DOUBLE / 4294967296e0 < r.rate - floor(r.rate)
    THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source
"""


def op4_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, F.col("vec_id") % 20 == 0, 20)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc.doc_id", "lang_pred", "score", "rejected").withColumn("held_out", crc_mod("doc_id", 3) == 1)


def op8_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    found = outliers.judge(docs).withColumn("doc_id", F.col("doc.doc_id")).drop("doc")
    return found.withColumn("distance", F.round("distance", 4))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path())


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return conversations.digested(conversations.repair(rows, F.col("absent"), F.col("copies")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.classify(docs, labels).withColumn("held_out", crc_mod("doc_id", 5) == 0)


def queries() -> dict[str, Query]:
    return {"op1_quality": op1_quality, "op2_warc": op2_warc, "op3_mix_sources": op3_mix_sources, "op4_recurrent": op4_recurrent, "op5_simhash": op5_simhash, "op6_neighbours": op6_neighbours, "op7_langid": op7_langid, "op8_outliers": op8_outliers, "op9_pack": op9_pack, "op10_substrings": op10_substrings, "op11_conversations": op11_conversations, "op12_toxicity": op12_toxicity}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op3_mix_sources": OP3_SQL, "op8_outliers": sql.outlier_sql(), "op10_substrings": sql.SUBSTRINGS, "op11_conversations": sql.CONVERSATIONS}
