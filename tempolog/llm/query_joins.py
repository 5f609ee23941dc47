"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from .jaccard import jaccard_groups


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of all documents: 3-word shingles, links at a similarity of 0.9."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_groups(docs, 3, Fraction(9, 10)).withColumnRenamed("id", "doc_id")
