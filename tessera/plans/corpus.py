"""The tables of a data folder seen as codebases, for the named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.languages import language_of
from tessera.functions.paths import file_extension, relative_path

ROOT = "/corpus"
#: The extension a document's language stands for.
EXT_OF_LANG = {"en": ".md", "fr": ".rs", "de": ".py", "es": ".txt"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_files(docs: DataFrame, *more: str) -> DataFrame:
    """(id, path, relative_path, ext, language, source, content): rows of ``documents`` as files; ``more`` columns are kept."""
    ext = F.lit("")
    for lang, e in EXT_OF_LANG.items():
        ext = F.when(F.col("lang") == lang, e).otherwise(ext)
    path = F.concat(F.lit(f"{ROOT}/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext)
    named = docs.select(F.col("doc_id").alias("id"), path.alias("path"), "source", F.col("text").alias("content"), *more)
    named = named.withColumn("ext", file_extension(F.col("path")))
    return named.select("id", "path", relative_path(F.col("path"), ROOT).alias("relative_path"), "ext", language_of(F.col("ext")).alias("language"), "source", "content", *more)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path, relative_path, ext, language, content): pages as HTML files."""
    path = F.concat(F.lit(f"{ROOT}/pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    named = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), path.alias("path"), F.col("html").alias("content"))
    return named.select("id", "path", relative_path(F.col("path"), ROOT).alias("relative_path"), F.lit(".html").alias("ext"), F.lit("html").alias("language"), "content")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of id 0: one row."""
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


#: DuckDB: the same view of documents.
FILES_SQL = """files AS (
  SELECT doc_id AS id, source, text AS content, CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.rs' WHEN 'de' THEN '.py' WHEN 'es' THEN '.txt' ELSE '' END AS ext,
    '/corpus/' || source || '/' || doc_id::VARCHAR || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.rs' WHEN 'de' THEN '.py' WHEN 'es' THEN '.txt' ELSE '' END AS path,
    source || '/' || doc_id::VARCHAR || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.rs' WHEN 'de' THEN '.py' WHEN 'es' THEN '.txt' ELSE '' END AS relative_path
  FROM documents
)"""
