"""Queries of the secret scans and of byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decoded, encode, ids_digest
from .secrets import digest_columns, secret_spans


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of secrets in all documents."""
    return digest_columns(secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens and digests of the ids and of the decoded bytes of all documents."""
    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2(decoded(F.col("ids")), 256).alias("decoded_sha256"))
