"""Policies over streams, with watermarks and bounded state, on Structured Streaming's own operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def fact_stream(spark: SparkSession, folder: str, schema: str, delay: str = "10 minutes", files: int | None = None) -> DataFrame:
    """Facts from Parquet files as they appear, with a watermark on column ts (a timestamp)."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder).withWatermark("ts", delay)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket (one partition, no recovery: for trials)."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def kafka_lines(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Lines of a topic from its beginning."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load().select(F.col("value").cast("string").alias("value"))


def once_within(guard: DataFrame, witness: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """`guard AND ONCE [low, high) witness` of two streams that share `key`; columns of the witness get the prefix w_.

    State is kept for `high` seconds beyond the watermarks of both sides."""
    w = witness.select(*[F.col(c).alias(f"w_{c}") for c in witness.columns])
    on = (F.col(key) == F.col(f"w_{key}")) & F.expr(f"w_ts <= ts - INTERVAL {low} SECONDS AND w_ts > ts - INTERVAL {high} SECONDS")
    return guard.join(w, on)


def relation_counts(facts: DataFrame, width: str = "60 seconds") -> DataFrame:
    """Facts of each relation in each tumbling window, final once the watermark has passed it."""
    return facts.groupBy(F.window("ts", width), "rel").agg(F.count("*").alias("count")).select(F.col("window.start").alias("start"), "rel", "count")


def reordered(facts: DataFrame, mode: str = "total") -> DataFrame:
    """Time-points of a stream with a watermark, each once and complete, as soon as the watermark has passed it: (ts, tp, facts).

    facts is the sorted array of (rel, args). `total`: by time-point and time-stamp. `collapsed`: all facts of a time-stamp are
    one time-point, and tp is null. Inputs whose watermarks are to be waited for are unioned before, each with its own
    withWatermark: Spark takes the least. A fact under the watermark is late and dropped (see `dropped`)."""
    if mode not in ("total", "collapsed"):
        raise ValueError(f"mode {mode!r}")
    tp = F.col("tp") if mode == "total" else F.lit(None).cast("bigint")
    body = F.sort_array(F.collect_list(F.struct("rel", "args"))).alias("facts")
    return facts.groupBy("ts", tp.alias("tp")).agg(body).select("ts", "tp", "facts")


def since_unbroken(facts: DataFrame, high: int) -> DataFrame:
    """`guard AND ((NOT broken) SINCE [0, high) witness)` for each key of a stream of (ts, tp, key, kind) with a watermark: rows
    (key, tp) of the guards that hold.

    kind: guard, witness or broken. A key's facts are held until the watermark has passed them and then taken by time-point; kept
    beyond is the last witness since which nothing broke, and no key outlives it by more than `high` seconds."""
    schema = StructType.fromDDL("tps array<bigint>, seconds array<bigint>, kinds array<string>, witness bigint")

    def run(key, frames, state: GroupState):
        tps, seconds, kinds, witness = state.get if state.exists else ([], [], [], None)
        rows = list(zip(tps, seconds, kinds, strict=True))
        for frame in frames:
            at = frame["ts"].astype("datetime64[us]").astype("int64") // 1_000_000
            rows += list(zip(frame["tp"].tolist(), at.tolist(), frame["kind"].tolist(), strict=True))
        mark = state.getCurrentWatermarkMs() // 1000
        # at one time-point what breaks comes first, then witnesses, then guards
        rows.sort(key=lambda r: (r[0], ("broken", "witness", "guard").index(r[2])))
        done, held = [r for r in rows if r[1] <= mark], [r for r in rows if r[1] > mark]
        out = []
        for tp, second, kind in done:
            if kind == "broken":
                witness = None
            elif kind == "witness":
                witness = second
            elif witness is not None and second - witness < high:
                out.append(tp)
        if witness is not None and mark - witness >= high:
            witness = None
        if held or witness is not None:
            state.update(tuple(map(list, zip(*held, strict=True))) + (witness,) if held else ([], [], [], witness))
            due = min([r[1] for r in held] + ([witness + high] if witness is not None else []))
            state.setTimeoutTimestamp(max(due, mark + 1) * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": [key[0]] * len(out), "tp": out}, columns=["key", "tp"])

    rows = facts.select("ts", F.col("tp").cast("bigint").alias("tp"), "key", "kind")
    return rows.groupBy("key").applyInPandasWithState(run, f"key {facts.schema['key'].dataType.simpleString()}, tp bigint", schema, "append", GroupStateTimeout.EventTimeTimeout)


def replayed(spark: SparkSession, facts: DataFrame, acceleration: float = 1.0) -> DataFrame:
    """A stream of a finished trace's facts in real time from the first on, `acceleration` seconds of the trace in each second."""
    first = facts.agg(F.min("ts").alias("first"))
    timed = facts.crossJoin(F.broadcast(first)).withColumn("second", F.floor((F.col("ts") - F.col("first")) / acceleration)).drop("first")
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load().withColumnRenamed("value", "second")
    return clock.join(timed, "second").drop("second", "timestamp")


def dropped(query: StreamingQuery) -> int:
    """Late rows that the query has dropped so far, as far as its recent progress tells."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def run_to_end(out: DataFrame, folder: str, checkpoint: str, strict: bool = False) -> None:
    """Writes all that is there now to Parquet; a later call goes on from the checkpoint. `strict` fails if late facts were
    dropped."""
    query = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    if strict and (n := dropped(query)):
        raise ValueError(f"{n} late facts")
