"""Traces: time-points and relations over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Trace:
    """timepoints: (tp, ts), tp dense from 0. find: a relation's table (tp, ts, arguments) by name."""

    timepoints: DataFrame
    find: Callable[[str], DataFrame]

    def relation(self, name: str) -> DataFrame:
        return self.find(name)


def from_facts(facts: DataFrame, timepoints: DataFrame, signature: dict[str, tuple[str, ...]]) -> Trace:
    """facts: (tp, ts, rel, args array<string>). signature: types of each relation's arguments (int, string or float).

    A relation becomes a filter on rel, which reaches the scan; facts of another arity are left out."""
    types = {"int": "bigint", "string": "string", "float": "double"}

    def find(name: str) -> DataFrame:
        kinds = signature[name]
        rows = facts.filter((F.col("rel") == name) & (F.size("args") == len(kinds)))
        return rows.select("tp", "ts", *[F.col("args")[i].try_cast(types[k]).alias(f"x{i}") for i, k in enumerate(kinds)])

    return Trace(timepoints, find)


def read_signature(text: str) -> dict[str, tuple[str, ...]]:
    """rel(arg:type, ...) or rel(type, ...), one relation after another."""
    import re

    return {name: tuple(x.split(":")[-1].strip() for x in inner.split(",") if x.strip()) for name, inner in re.findall(r"(\w+)\s*\(([^)]*)\)", text)}


def seconds(c: str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def events_trace(spark: SparkSession, sf_dir: str) -> Trace:
    """`events`, each row its own time-point; a relation (user, event) for each event type."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("tp"), seconds("ts").alias("ts"), "user_id", "event_type")
    return Trace(rows.select("tp", "ts"), lambda name: rows.filter(F.col("event_type") == name).select("tp", "ts", F.col("user_id").alias("x0"), F.col("tp").alias("x1")))


def orders_trace(spark: SparkSession, sf_dir: str) -> Trace:
    """`orders` by day; relations ord_F, ord_O and ord_P (customer, order) by status."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(seconds("o_orderdate").alias("ts"), "o_custkey", "o_orderkey", "o_orderstatus")
    days = rows.select("ts").distinct().withColumn("tp", (F.row_number().over(Window.orderBy("ts")) - 1).cast("bigint")).select("tp", "ts")
    placed = rows.join(days, "ts")
    return Trace(days, lambda name: placed.filter(F.col("o_orderstatus") == name.removeprefix("ord_")).select("tp", "ts", F.col("o_custkey").alias("x0"), F.col("o_orderkey").alias("x1")))


def collapsed(trace_rows: DataFrame) -> DataFrame:
    """Facts of equal time-stamps at one time-point (tp becomes the rank of ts)."""
    days = trace_rows.select("ts").distinct().withColumn("tp", (F.row_number().over(Window.orderBy("ts")) - 1).cast("bigint"))
    return trace_rows.drop("tp").join(days, "ts")
