"""Mixing sources to target weights by a time-varying curriculum, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value of the contract: a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Between a word and the white space after it.
_AFTER = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, tilts: tuple[float, ...] = (0.0,)) -> DataFrame:
    """Rows (source, source_size, weight, target, tilt), one for each source.

    Sources in code-point order, null last, get the weights and the tilts in turn. The targets share the sum of all sizes by weight and
    stop at `most` times the source's size; what is over is shared again by weight until no target is above. In order of
    size / weight the stopped sources come first, so the level is found in one pass of running sums over the sources.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("bigint").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), ((rank - 1) % len(values) + 1).cast("int"))
    per = per.withColumn("weight", turn(weights)).withColumn("tilt", turn(tilts))
    per = per.withColumn("cap", (F.col("source_size") * most).cast("double"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("weights", F.sum("weight").over(every))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source that its share doesn't fill sets the level for all that come after it
    free = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "source_size", "level"))).over(every)
    per = per.withColumn("target", F.when(free.isNull(), F.col("cap")).otherwise(F.least("cap", free["level"] * F.col("weight"))))
    return per.select("source", "source_size", "weight", "target", "tilt")


def _position(start: Column, target: Column, tilt: Column) -> Column:
    """The time at which the demand of a source reaches `start` words: its integral, t + a (t^2 - t), inverted."""
    u = F.least(F.lit(1.0), start / target)
    return F.when(tilt == 0, u).otherwise((tilt - 1 + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u)) / (2 * tilt))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), tilts: tuple[float, ...] = (-0.5, 0.0, 0.5), most: int = 3) -> DataFrame:
    """`docs` with columns size, source_size, target, taken, position, start and tilt added (one row for each row of `docs`).

    size counts the words of the text (null: 0). Within a source documents follow the digest of their id; running sums of
    sizes give each a range of the source's token demand. Full passes take every document, and the last, partial pass
    takes them in order until the target (rounded to a word) is met, so that the last document is taken in part: taken
    counts words with repeats, sums to the target of the source, and never exceeds `most` times the size.

    Sources in code-point order, null last, get `weights` and `tilts` in turn. A source with tilt a has weight
    1 + a (2t - 1) at time t of the training; its integral t + a (t^2 - t) is inverted at the document's start in the demand
    (start, in words): position, from 0 to 1, of its first use (null if taken is 0). Later uses start source_size words further
    each; `training_order` inverts the integral for every one.

    Running sums are taken in 4096 buckets of each source, with the buckets' sums added beforehand, so that one source
    with a third of all rows is spread over all tasks. Rows without id come first in order; equal ids are ordered by size.
    Documents without words are taken 0 times. Columns of `docs` with the names of the added ones are replaced, others stay
    whatever their names. An empty table gives no rows.
    """
    added = ("size", "source_size", "target", "taken", "position", "start", "tilt")
    keep = docs.select(*[c for c in docs.columns if c.lower() not in added])
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    # by place instead of by name, so that no name clashes and columns that nobody asks for aren't shuffled
    rows = keep.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep.columns)], F.col(source_col).alias("s"), word_count(F.col(text_col)).alias("n"), key.alias("k")).withColumn("b", F.substring("k", 1, 3))
    buckets = rows.groupBy("s", "b").agg(F.sum("n").alias("words"))
    targets = source_targets(buckets, "s", "words", weights, most, tilts).withColumnRenamed("source", "t")
    before = F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = buckets.withColumn("before", before).join(targets, F.col("s").eqNullSafe(F.col("t")))
    plan = plan.select(F.col("s").alias("ps"), F.col("b").alias("pb"), "before", "source_size", "target", "tilt")
    running = Window.partitionBy("s", "b").orderBy("k", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(plan, F.col("s").eqNullSafe(F.col("ps")) & (F.col("b") == F.col("pb"))).withColumn("start", F.col("before") + F.sum("n").over(running) - F.col("n"))
    goal = F.round("target").cast("bigint")
    full = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("bigint")
    part = F.greatest(F.lit(0), F.least(F.col("n"), goal - full * F.col("source_size") - F.col("start")))
    taken = (full * F.col("n") + part).cast("bigint")
    position = F.when(taken > 0, _position(F.col("start"), F.col("target"), F.col("tilt")))
    return rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep.columns)], F.col("n").alias("size"), "source_size", "target", taken.alias("taken"), position.alias("position"), "start", "tilt")


def training_order(planned: DataFrame, text_col: str | None = None, tie: str | None = None) -> DataFrame:
    """A row for every use of a document (columns use, from 0, and words, the words of that use), sorted over all partitions by
    that use's position, then use, then column `tie`.

    The last use may be in part; with `text_col` that column then holds the first of its words only."""
    uses = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = planned.filter("taken > 0").withColumn("use", F.explode(F.sequence(F.lit(0), uses - 1)))
    rows = rows.withColumn("position", _position(F.col("start") + F.col("use") * F.col("source_size"), F.col("target"), F.col("tilt")))
    rows = rows.withColumn("words", F.least("size", F.col("taken") - F.col("use") * F.col("size")).cast("bigint"))
    if text_col:
        first = F.array_join(F.slice(F.split(text_col, _AFTER), F.lit(1), F.col("words").cast("int")), "")
        rows = rows.withColumn(text_col, F.when(F.col("words") < F.col("size"), first).otherwise(F.col(text_col)))
    return rows.orderBy("position", "use", *([tie] if tie else []))
