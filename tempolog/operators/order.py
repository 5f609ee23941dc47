"""Numbers, running values and latest values in an order, without a task that sees all rows.

Rows are cut into buckets of the order. Each bucket is a window of its own, and what the buckets before it add up to is
carried over from a table of one row for each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a dense order, such as time-points or lines, in a bucket.
PLACES = 1 << 16


def so_far(rows: DataFrame, value: Column, how: str, bucket: Column, order: Sequence[str | Column], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """`rows` with column `name`: sum, min or max (`how`) of `value` over the rows before each, null for the first.

    The order is `bucket` first, then `order` within it. Rows that tie are taken in any order. With `keys`, for each key."""
    agg = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    rows = rows.withColumns({"_bucket": bucket, "_value": value})
    per = rows.groupBy(*keys, "_bucket").agg(agg("_value").alias("_own"))
    per = per.withColumn("_prior", agg("_own").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    per = per.select(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_at"), "_prior")
    on = F.col("_bucket").eqNullSafe(F.col("_at"))
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_of_{i}"))
    own = agg("_value").over(Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("_own", own).join(per, on, "left")
    if how == "sum":
        both = F.when(F.col("_own").isNull() & F.col("_prior").isNull(), None).otherwise(F.coalesce("_own", F.lit(0)) + F.coalesce("_prior", F.lit(0)))
    else:
        both = (F.greatest if how == "max" else F.least)("_own", "_prior")
    return out.withColumn(name, both).select(*[c for c in rows.columns if c not in ("_bucket", "_value", name)], name)


def numbered(rows: DataFrame, order: str, name: str, then: Sequence[str | Column] = (), places: int = PLACES) -> DataFrame:
    """`rows` with column `name`: their place, from 0, by the integer column `order` and then by `then`."""
    out = so_far(rows, F.lit(1), "sum", F.floor(F.col(order) / places), [order, *then], "_place")
    return out.withColumn(name, F.coalesce("_place", F.lit(0)).cast("bigint")).drop("_place")


def _merged(left: DataFrame, right: DataFrame, keys: Sequence[str], left_bucket: Column, left_at: Column, right_bucket: Column, right_at: Column, value: Column) -> DataFrame:
    """Both sides' rows, with _bucket, _time and _side (0 for the right, whose `value` is _it); null keys of the right go."""
    side = right.dropna(subset=list(keys)) if keys else right
    kind = right.select(value.alias("v")).schema["v"].dataType
    own = left.select(*left.columns, left_bucket.alias("_bucket"), left_at.alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_it"))
    other = [F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns]
    return own.union(side.select(*other, right_bucket.alias("_bucket"), right_at.alias("_time"), F.lit(0).alias("_side"), value.alias("_it")))


def latest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: Column, right_at: Column, value: Column, width: int, name: str) -> DataFrame:
    """`left` with column `name`: the largest `value` of the rows of `right` with equal keys and right_at <= left_at, else null.

    Both are merged in one order instead of being joined by a range. `width`: of the buckets of that order. Null keys match
    nothing. Both sides are evaluated twice."""
    both = _merged(left, right, keys, F.floor(left_at / width), left_at, F.floor(right_at / width), right_at, value)
    out = so_far(both.withColumnRenamed("_bucket", "_part"), F.col("_it"), "max", F.col("_part"), ["_time", "_side"], name, keys)
    return out.filter("_side = 1").select(*left.columns, name)


def latest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: Column, right_at: Column, value: Column, place: Column, reach: tuple[Column, Column], width: int, name: str) -> DataFrame:
    """`latest` where a row of the right side counts only for rows of the left whose `place` lies in its `reach` (both ends
    included): others may be found or not. Rows of the right are dealt to the few buckets of places that they reach."""
    low, high = (F.floor(x / width) for x in reach)
    both = _merged(left, right.withColumn("_deal", F.explode(F.sequence(low, high))), keys, F.floor(place / width), left_at, F.col("_deal"), right_at, value)
    w = Window.partitionBy(*keys, "_bucket").orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.max("_it").over(w)).filter("_side = 1").select(*left.columns, name)
