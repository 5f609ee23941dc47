"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line; each runs once to warm up."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tempolog.plans.compile import monitor
from tempolog.queries import QUERIES
from tempolog.sources import generate
from tempolog.sources.trace import from_facts

#: Facts of generated traces: 60 seconds at 25,000 a second, as the baseline's smallest grid has.
GENERATED = {"star": 60, "linear": 60, "triangle": 60}
RATE = 25_000
NAMES = ("star_neg", "triangle_neg", "linear_neg", "easy_neg", "past_nested", "once_bounded", "eventually_delayed", "since_neg", "until_pos", "historically_held", "del_1_2", "stats_heavy", "slice_assign", "trace_database_roundtrip")


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    rates = {}
    for shape, seconds in GENERATED.items():
        facts = generate.pattern_trace(spark, shape, seconds, RATE).persist()
        signature = {r: ("int", "int") for r in "ABC"}
        trace = from_facts(facts, facts.select("tp", "ts").distinct(), signature)
        n = facts.count()
        start = time.perf_counter()
        monitor(generate.policy_text(shape), trace, negate=True).write.format("noop").mode("overwrite").save()
        rates[shape] = round(n / (time.perf_counter() - start))
        facts.unpersist()
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "events_per_second": rates, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
