"""Queries of the quality rules, the quality classifier and the toxicity classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decision_list import apply_rules, learn_rules
from .toxicity import scored, train
from .weak_labels import weak_quality


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents; rules learned from labels.quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return apply_rules(docs, rules).select(F.col("id").alias("doc_id"), *counts, failed.alias("base_failed"), (~failed & (F.col("rule") == 0)).alias("kept"), "rule")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, score and verdict of all documents."""
    return weak_quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out, score and predicted of all documents; labels of held-out rows are never read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    model = train(docs, labels)
    return scored(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
