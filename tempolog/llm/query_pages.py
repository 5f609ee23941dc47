"""Query of HTML extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_render import extract


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and visible text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(F.col("id").alias("page_id"), "text")
