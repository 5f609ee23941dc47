"""Trace statistics: counts by tumbling window, heavy hitters, histograms, running measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed(facts: DataFrame, width: int, ts: str = "ts") -> DataFrame:
    """`facts` with the start of its tumbling window."""
    return facts.withColumn("start", (F.floor(F.col(ts) / width) * width).cast("bigint"))


def relation_frequency(facts: DataFrame, width: int = 60, by: tuple[str, ...] = ("rel",)) -> DataFrame:
    """(start, by..., count): facts of each relation (or slice and relation) in each window."""
    return windowed(facts, width).groupBy("start", *by).agg(F.count("*").alias("count"))


def attribute_values(facts: DataFrame) -> DataFrame:
    """A row (rel, attribute, value) for each argument, with the other columns."""
    keep = [c for c in facts.columns if c != "args"]
    return facts.select(*keep, F.posexplode("args").alias("attribute", "value"))


def heavy_hitters(facts: DataFrame, width: int = 60, degree: int = 16, least: int = 1) -> DataFrame:
    """(start, rel, attribute, value, count, total) with count >= max(ceil(total / (2 degree)), least), exact."""
    w = windowed(facts, width)
    total = w.groupBy("start", "rel").agg(F.count("*").alias("total"))
    count = attribute_values(w).groupBy("start", "rel", "attribute", "value").agg(F.count("*").alias("count"))
    limit = F.greatest(F.ceil(F.col("total") / (2 * degree)), F.lit(least))
    return count.join(total, ["start", "rel"]).filter(F.col("count") >= limit).select("start", "rel", "attribute", "value", "count", "total")


def statistics_lines(frequency: DataFrame, heavy: DataFrame, counts: bool = False) -> DataFrame:
    """start,relation,count;hitters of attribute 0;... as lines."""
    entry = F.concat_ws(":", "value", "count") if counts else F.col("value")
    per = heavy.groupBy("start", "rel", "attribute").agg(F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("hitters"))
    per = per.groupBy("start", "rel").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("attribute", "hitters"))), lambda x: x["hitters"]), ";").alias("hitters"))
    return frequency.join(per, ["start", "rel"], "left").select("start", "rel", F.concat_ws(";", F.concat_ws(",", "start", "rel", "count"), "hitters").alias("line"))


def histogram(facts: DataFrame) -> DataFrame:
    """(rel, attribute, value, cnt, rel_cnt)."""
    total = facts.groupBy("rel").agg(F.count("*").alias("rel_cnt"))
    return attribute_values(facts).groupBy("rel", "attribute", "value").agg(F.count("*").alias("cnt")).join(total, "rel")


def merged_histograms(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pointwise sums of two histograms."""
    return a.unionByName(b).groupBy("rel", "attribute", "value").agg(F.sum("cnt").alias("cnt"), F.sum("rel_cnt").alias("rel_cnt"))


def frequent(hist: DataFrame, degree: int) -> DataFrame:
    """Values whose share of the relation exceeds 1 / (2 degree)."""
    return hist.filter(F.col("cnt") * (2 * degree) > F.col("rel_cnt"))


def merged_heavy(heavy: DataFrame, windows: int = 2) -> DataFrame:
    """(rel, attribute, value, windows) of hitters seen in that many windows or more."""
    return heavy.groupBy("rel", "attribute", "value").agg(F.count_distinct("start").alias("windows")).filter(F.col("windows") >= windows)


def cut(facts: DataFrame, start: int, end: int) -> DataFrame:
    """Facts of the time range [start, end)."""
    return facts.filter((F.col("ts") >= start) & (F.col("ts") < end))


def running(rows: DataFrame, value: str, by: str, order: str) -> DataFrame:
    """`rows` with the maximum and mean of a measure so far, for each key."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("max_so_far", F.max(value).over(w)).withColumn("mean_so_far", F.avg(value).over(w))


def sliding_frames(counts: DataFrame, frames: int, width: int, by: tuple[str, ...] = ("rel",)) -> DataFrame:
    """(start, by..., count) summed over the last `frames` windows."""
    w = Window.partitionBy(*by).orderBy("start").rangeBetween(-(frames - 1) * width, 0)
    return counts.select("start", *by, F.sum("count").over(w).alias("count"))


def value_frequency(facts: DataFrame, width: int = 60) -> DataFrame:
    """(start, rel, attribute, value, count): how often each value occurs in each window."""
    return attribute_values(windowed(facts, width)).groupBy("start", "rel", "attribute", "value").agg(F.count("*").alias("count"))


def timepoint_frequency(timepoints: DataFrame, width: int = 60) -> DataFrame:
    """(start, rel, count) of the relation without a name, which stands for the time-points."""
    return windowed(timepoints, width).groupBy("start").agg(F.count("*").alias("count")).select("start", F.lit("").alias("rel"), "count")


def split_statistics(lines: DataFrame, text: str = "line") -> DataFrame:
    """(start, rel, count, attribute, value): the hitters of statistics lines, one a row; a relation without any has one row
    with null attribute and value."""
    parts = F.split(text, ";")
    head = F.split(parts[0], ",")
    hitters = F.flatten(F.transform(F.slice(parts, 2, 1 << 30), lambda p, i: F.transform(F.filter(F.split(p, ","), lambda v: v != ""), lambda v: F.struct(i.alias("attribute"), v.alias("value")))))
    rows = lines.select(head[0].cast("bigint").alias("start"), head[1].alias("rel"), head[2].cast("bigint").alias("count"), F.explode_outer(hitters).alias("h"))
    return rows.select("start", "rel", "count", "h.attribute", "h.value")


def relation_sizes(hist: DataFrame) -> DataFrame:
    """(rel, size) from a histogram; relations without arguments have no rows in one."""
    return hist.groupBy("rel").agg(F.max("rel_cnt").alias("size"))


def constant_sizes(names: list[str], size: float = 100.0) -> dict[str, float]:
    """Sizes for planning without statistics."""
    return dict.fromkeys(names, size)


def sampled(facts: DataFrame, start: int, seconds: float = 4.5, least: int = 5, most: int = 25, seed: int = 1) -> DataFrame:
    """A sample for a histogram: of the facts in `seconds` from `start` on, one in each `least` to `most`, on average."""
    return facts.filter((F.col("ts") >= start) & (F.col("ts") < start + seconds)).sample(2 / (least + most), seed)


def latency(markers: DataFrame) -> DataFrame:
    """(second, peak, max_so_far, average_so_far) of markers (idx, sent, seen), which each parallel path sees once: a marker's
    latency is that of the last path; peak is the largest in a second of arrival. One row for each second."""
    one = markers.groupBy("idx").agg(F.max("seen").alias("seen"), F.max(F.col("seen") - F.col("sent")).alias("delay"))
    per = one.groupBy(F.floor("seen").alias("second")).agg(F.max("delay").alias("peak"), F.sum("delay").alias("total"), F.count("*").alias("n"))
    w = Window.orderBy("second").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.select("second", "peak", F.max("peak").over(w).alias("max_so_far"), (F.sum("total").over(w) / F.sum("n").over(w)).alias("average_so_far"))
