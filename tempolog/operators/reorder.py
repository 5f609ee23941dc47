"""Facts that arrive out of order: emission times, restored order, and what comes too late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import numbered, so_far


def emitted(facts: DataFrame, most: int = 1200) -> DataFrame:
    """`facts` with an emission time of at most `most` seconds after the time-stamp, fixed by the time-point."""
    return facts.withColumn("emission", F.col("ts") + (F.col("tp") * 7919) % most)


def restored(arrived: DataFrame) -> DataFrame:
    """Facts in the order of their time-points (one fact each), with their position.

    Ranges of time-points are numbered by themselves, and the counts of the ranges before are added."""
    return numbered(arrived, "tp", "pos")


def late(arrived: DataFrame, delay: int) -> DataFrame:
    """Facts older than the watermark (the largest time-stamp that arrived before them, less `delay`)."""
    seen = so_far(arrived, F.col("ts"), "max", F.floor(F.col("emission") / 3600), ["emission", "tp"], "_mark")
    return seen.filter(F.col("ts") < F.col("_mark") - delay).drop("_mark")


def gap_points(timepoints: DataFrame) -> DataFrame:
    """A time-point for every second between the first and the last, as collapsed traces have."""
    ends = timepoints.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("ts"))
