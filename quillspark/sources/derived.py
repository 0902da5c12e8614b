"""The search index's tables, derived from the driver's tables, and the same as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

SCHEME = "quill"
MODEL = "mock-embedder"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: collection, path, title, hash, body, active, modified_at."""
    raw = read_table(spark, sf_dir, "documents")
    return raw.select(
        "doc_id", F.col("source").alias("collection"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.sha2("text", 256).alias("hash"), F.col("text").alias("body"), (F.col("doc_id") % 10 != 0).alias("active"),
        F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("modified_at"),
    )


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies, each stored once under its hash."""
    return documents(spark, sf_dir).groupBy("hash").agg(F.min("body").alias("doc"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chunk vectors a document; every seventh document claims a third that is not there."""
    raw = read_table(spark, sf_dir, "embeddings")
    doc = F.floor(F.col("vec_id") / 2).cast("long")
    return raw.select(
        "vec_id", doc.alias("doc_id"), (F.col("vec_id") % 2).cast("int").alias("seq"), ((F.col("vec_id") % 2) * 3060).cast("int").alias("pos"), "embedding",
        F.lit(MODEL).alias("model"), F.concat(F.lit("fp"), (F.col("label") % 3).cast("string")).alias("fingerprint"), F.when(doc % 7 == 0, 3).otherwise(2).alias("total_chunks"),
    )


SQL = """docs AS (
  SELECT doc_id, source AS collection, lang || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, split_part(text, chr(10), 1) AS title,
    sha256(text) AS hash, text AS body, doc_id % 10 <> 0 AS active,
    strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS BIGINT)), '%Y-%m-%dT%H:%M:%S.000Z') AS modified_at FROM documents),
content AS (SELECT hash, min(body) AS doc FROM docs GROUP BY hash),
vecs AS (
  SELECT vec_id, vec_id // 2 AS doc_id, CAST(vec_id % 2 AS INT) AS seq, CAST((vec_id % 2) * 3060 AS INT) AS pos, embedding,
    'mock-embedder' AS model, 'fp' || CAST(label % 3 AS VARCHAR) AS fingerprint, CASE WHEN (vec_id // 2) % 7 = 0 THEN 3 ELSE 2 END AS total_chunks FROM embeddings)"""
