"""Query of the document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .winnowing import digest, edited_fingerprints


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, as digests, with their likeness."""
    rows = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("fingerprint")).alias("fingerprint"),
        digest(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.size("fingerprint").alias("n_hashes"),
    )
