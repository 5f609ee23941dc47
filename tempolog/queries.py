"""The catalogue: queries over the driver's tables, and the SQL to compare them with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import reorder, slicing, stats
from .plans.compile import monitor
from .plans.definition import EVENTS, ORDERS, definition_sql
from .plans.formula import parse
from .sources import formats
from .sources.trace import collapsed, events_trace, orders_trace, seconds
from .streaming import live

STAR = "((ONCE [0,1d) view(u,a)) AND purchase(u,b)) AND EVENTUALLY [0,1d) error(u,c)"
#: name: (trace, policy, negate)
POLICIES: dict[str, tuple[str, str, bool]] = {
    "pred_scan": ("events", "purchase(u,e)", False),
    "pred_const": ("events", "purchase(7,e)", False),
    "pred_repeat": ("orders", "ord_F(c,c)", False),
    "eq_filter": ("events", "purchase(u,e) AND u = 7", False),
    "eq_binds": ("events", "purchase(u,e) AND k = 5", False),
    "less_filter": ("events", "purchase(u,e) AND u < 10", False),
    "not_less": ("events", "purchase(u,e) AND NOT u < 10", False),
    "true_rel": ("events", "TRUE", False),
    "false_rel": ("events", "FALSE", False),
    "and_join": ("orders", "ord_F(c,o) AND ord_O(c,p)", False),
    "and_not": ("orders", "ord_F(c,o) AND NOT (EXISTS p. ord_O(c,p))", False),
    "or_union": ("events", "click(u,e) OR view(u,e)", False),
    "not_closed": ("events", "NOT (EXISTS u,e. error(u,e))", False),
    "exists_proj": ("orders", "EXISTS o. ord_F(c,o)", False),
    "forall_guarded": ("orders", "ord_F(c,o) AND (FORALL p. ord_O(c,p) IMPLIES p < 0)", False),
    "implies_negated": ("orders", "ord_F(c,o) IMPLIES ord_O(c,o)", True),
    "prev_gap": ("events", "PREV [0,60] purchase(u,e)", False),
    "next_gap": ("events", "NEXT [0,60] purchase(u,e)", False),
    "once_bounded": ("events", "purchase(u,e) AND ONCE [0,1d) view(u,a)", False),
    "once_delayed": ("events", "purchase(u,e) AND ONCE [1h,1d) view(u,a)", False),
    "once_unbounded": ("events", "purchase(u,e) AND ONCE [0,*) (EXISTS a. signup(u,a))", False),
    "once_unguarded": ("events", "ONCE [0,10m) error(u,e)", False),
    "eventually_bounded": ("events", "purchase(u,e) AND EVENTUALLY [0,1d) error(u,a)", False),
    "eventually_delayed": ("events", "purchase(u,e) AND EVENTUALLY [1h,1d) error(u,a)", False),
    "since_pos": ("events", "purchase(u,e) AND ((NOT (EXISTS v,w. error(v,w))) SINCE [0,1d) view(u,a))", False),
    "since_neg": ("events", "purchase(u,e) AND ((NOT (EXISTS a. error(u,a))) SINCE [0,2d) (EXISTS b. signup(u,b)))", False),
    "since_run": ("events", "purchase(u,e) AND (((EXISTS v,w. click(v,w)) OR (EXISTS v,w. purchase(v,w))) SINCE [0,6h) click(v,w))", False),
    "until_pos": ("events", "purchase(u,e) AND (((EXISTS v,w. view(v,w)) OR (EXISTS v,w. purchase(v,w))) UNTIL [0,6h) click(v,w))", False),
    "until_neg": ("events", "purchase(u,e) AND ((NOT (EXISTS a. error(u,a))) UNTIL [0,2d) (EXISTS b. signup(u,b)))", False),
    "historically_guarded": ("events", "purchase(u,e) AND HISTORICALLY [0,10m) NOT (EXISTS w,f. error(w,f))", False),
    "always_guarded": ("events", "purchase(u,e) AND ALWAYS [0,10m) NOT (EXISTS w,f. error(w,f))", False),
    "historically_held": ("events", "purchase(u,e) AND HISTORICALLY [0,5m) (EXISTS w,f. purchase(w,f))", False),
    "always_held": ("events", "purchase(u,e) AND ALWAYS [1,5m) (EXISTS w,f. view(w,f))", False),
    "trigger_guarded": ("events", "purchase(u,e) AND ((EXISTS a. signup(u,a)) TRIGGER [0,1d) NOT (EXISTS b. error(u,b)))", False),
    "release_guarded": ("events", "purchase(u,e) AND ((EXISTS a. signup(u,a)) RELEASE [0,1d) NOT (EXISTS b. error(u,b)))", False),
    "star_neg": ("events", STAR, False),
    "linear_neg": ("events", "((ONCE [0,1d) view(u,a)) AND purchase(u,b)) AND EVENTUALLY [0,1h) error(v,b)", False),
    "triangle_neg": ("orders", "((ONCE [0,10d) ord_F(a,b)) AND ord_P(a,c)) AND EVENTUALLY [0,10d) ord_O(a,d)", False),
    "star_policy_negated": ("events", "(ONCE [0,1d) view(u,a)) IMPLIES purchase(u,b) IMPLIES ALWAYS [0,1d) NOT error(u,c)", True),
    "easy_neg": ("events", "purchase(u,e) AND (ONCE [1,3h] view(u,a)) AND (ONCE [1,3h] click(u,b))", False),
    "past_nested": ("orders", "(ONCE [0,30d) ((ONCE [0,30d) ord_F(c,o)) AND ord_O(c,p))) AND ord_P(c,q)", False),
    "ins_1_2": ("events", "purchase(u,e) AND NOT (ONCE [0,1d) EXISTS a. view(u,a)) AND NOT (EVENTUALLY [0,1d) EXISTS a. view(u,a))", False),
    "del_1_2": ("events", "error(u,e) AND NOT u = 3 AND (NOT EVENTUALLY [0,30h) EXISTS a. signup(u,a)) AND NOT (ONCE [0,30h) EXISTS a. click(u,a))", False),
    "ins_3_2": ("events", "signup(u,e) AND NOT (EVENTUALLY [0,60) EXISTS a. click(u,a)) AND NOT (ONCE [0,60) EXISTS a. click(u,a))", False),
    "runtime": ("events", "signup(u,e) AND EVENTUALLY [1,3h) error(u,f)", False),
    "svn2": ("events", "signup(u,e) AND (ONCE [0,1d) click(u,f)) AND f < e", False),
    "custom_neg": ("orders", "ord_F(c,o) AND NOT ((NOT (EXISTS p. ord_P(c,p))) SINCE [0,300d) (EXISTS q. ord_O(c,q)))", False),
    "script1": ("events", "purchase(u,e) AND ((NOT (EXISTS a. signup(u,a))) SINCE [1,6h) click(u,b))", False),
}
_TRACES = {"events": (events_trace, EVENTS), "orders": (orders_trace, ORDERS)}


def _policy(name: str) -> Callable[[SparkSession, str], DataFrame]:
    trace, policy, negate = POLICIES[name]
    return lambda spark, sf_dir: monitor(policy, _TRACES[trace][0](spark, sf_dir), negate)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as facts (tp, ts, rel, args): relation by type, arguments user and event."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("event_id").alias("tp"), seconds("ts").alias("ts"), F.col("event_type").alias("rel"), F.array(F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("args"))


_E = "e AS (SELECT event_id AS tp, epoch_us(ts) // 1000000 AS ts, event_type AS rel, CAST(user_id AS VARCHAR) AS u, CAST(event_id AS VARCHAR) AS e FROM events)"
DAY = 86400
_SIZES = {"view": 1.0, "purchase": 1.0, "error": 1.0}
_SLICED = parse("(view(u,a) AND purchase(u,b)) AND error(v,b)")


def _seed(variable: str) -> int:
    return _slicer().seeds[variable]


def _slicer() -> slicing.Slicer:
    return slicing.Slicer.of(_SLICED, _SIZES, 8)


def _slice_sql() -> str:
    """Slices by the same arithmetic, with each variable's coordinate spelled out."""
    s = _slicer()
    shares, sides, stride = s.shares[()], [], {}
    at = 1
    for v, n in shares.items():
        stride[v] = at
        at *= n
    for a in _SLICED.atoms():
        free = [v for v in shares if v not in a.variables()]
        columns = {t.name: f"x{i}" for i, t in enumerate(a.terms)}
        cells = [f"(((CAST({columns[v]} AS BIGINT) * 7919 + {s.seeds[v] * 104729}) % {shares[v]}) + {shares[v]}) % {shares[v]} * {stride[v]}" for v in columns]
        cells += [f"r_{v} * {stride[v]}" for v in free]
        joins = "".join(f", (SELECT unnest(range({shares[v]})) AS r_{v})" for v in free)
        sides.append(f"SELECT tp, ts, rel, CAST({' + '.join(cells)} AS INTEGER) AS slice FROM x{joins} WHERE rel = '{a.name}'")
    return f"WITH {_E}, x AS (SELECT tp, ts, rel, u AS x0, e AS x1 FROM e) " + " UNION ".join(sides)


def slice_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slicer().assign(facts(spark, sf_dir)).select("tp", "ts", "rel", "slice")


def slice_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.load(slice_assign(spark, sf_dir))


def named_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`facts` with users as text."""
    return facts(spark, sf_dir).withColumn("args", F.array(F.concat(F.lit("user "), F.col("args")[0]), F.col("args")[1]))


def verdict_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship policy evaluated in each of 8 slices, with a heavy user; each verdict from the slice that it belongs to."""
    f = named_facts(spark, sf_dir)
    s = slicing.Slicer.of(parse(STAR), _SIZES, 8, {"u": ("user 7",)})
    return s.verdicts(f, f.select("tp", "ts").distinct(), dict.fromkeys(_SIZES, ("string", "int")))


def relevant_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.relevant(parse("view(u,a) AND ONCE purchase(7,b)"), facts(spark, sf_dir)).select("tp", "ts", "rel")


def slicing_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.costs(facts(spark, sf_dir), {"one": slicing.Slicer.fixed(_SLICED, "u=1"), "users": slicing.Slicer.fixed(_SLICED, "u=4")})


_TRIANGLE = parse("(view(x,y) AND purchase(y,z)) AND error(z,x)")


def share_opt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a triangle from the relations' sizes (a row each)."""
    sizes = {r["rel"]: float(r["count"]) for r in facts(spark, sf_dir).groupBy("rel").count().collect()}
    rows = [(d, v, n) for d in (8, 64) for v, n in slicing.optimal_shares(_TRIANGLE, sizes, d).items()]
    return spark.createDataFrame(rows, "degree int, variable string, share int")


def share_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.planned_shares(facts(spark, sf_dir), _TRIANGLE, DAY, 8, "reactive")


def stats_rel_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.relation_frequency(facts(spark, sf_dir), DAY)


def stats_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.relation_frequency(slice_assign(spark, sf_dir), DAY, ("slice", "rel"))


def stats_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.heavy_hitters(facts(spark, sf_dir), DAY, 16, 2)


def stats_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    frequency = stats.relation_frequency(f, DAY).union(stats.timepoint_frequency(f.select("tp", "ts").distinct(), DAY))
    return stats.statistics_lines(frequency, stats.heavy_hitters(f, DAY, 16, 2))


def stats_heavy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return stats.statistics_lines(stats.relation_frequency(f, DAY), stats.heavy_hitters(f, DAY, 16, 2), True)


def split_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.split_statistics(stats_lines(spark, sf_dir)).filter("rel <> ''")


def sliding_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sliding_frames(stats.value_frequency(facts(spark, sf_dir), DAY), 3, DAY, ("rel", "attribute", "value")).filter("attribute = 0")


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth event as a marker that two paths see, one of them three seconds after the other."""
    sent = reorder.emitted(facts(spark, sf_dir)).filter("tp % 10 = 0")
    return stats.latency(sent.select(F.col("tp").alias("idx"), F.col("ts").alias("sent"), F.explode(F.array(F.col("emission"), F.col("emission") + 3)).alias("seen")))


def reorder_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that arrive out of order, with a time-point for each second that has any."""
    return collapsed(reorder.emitted(facts(spark, sf_dir)).drop("emission")).select("tp", "ts", "rel", F.array_join("args", "|").alias("args"))


def gap_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reorder.gap_points(facts(spark, sf_dir).filter("tp < 200").select("tp", "ts"))


def _event_stream(spark: SparkSession, sf_dir: str, delay: str) -> DataFrame:
    """`events` as a stream of facts (tp, ts, rel, args, user), with time-stamps in whole seconds."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(kind).parquet(f"{sf_dir}/event[s].parquet")
    return rows.select(F.col("event_id").alias("tp"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("rel"), F.array(F.col("event_id").cast("string")).alias("args"), F.col("user_id").alias("user")).withWatermark("ts", delay)


def _ended(spark: SparkSession, out: DataFrame) -> DataFrame:
    """What a stream over all files that are there gives, from a folder that all machines share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="streams-")
    folder = f"{shared}/{uuid.uuid4()}"
    live.run_to_end(out, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def stream_once_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = lambda rel: _event_stream(spark, sf_dir, "1 day").filter(F.col("rel") == rel).select("tp", "ts", "user")
    joined = live.once_within(facts("purchase"), facts("view"), "user", 0, DAY).filter("w_tp <= tp")
    return _ended(spark, joined.select("tp", F.col("user").alias("u"), F.col("w_tp").alias("a")))


def stream_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.reordered(_event_stream(spark, sf_dir, "1 day"))
    return _ended(spark, out.select(F.unix_timestamp("ts").alias("ts"), "tp", F.size("facts").alias("n"), F.col("facts")[0]["rel"].alias("rel")))


def stream_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.reordered(_event_stream(spark, sf_dir, "1 day"), "collapsed")
    return _ended(spark, out.select(F.unix_timestamp("ts").alias("ts"), F.size("facts").alias("n")))


def stream_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`purchase(u,e) AND ((NOT (EXISTS a. error(u,a))) SINCE [0,2d) (EXISTS b. signup(u,b)))` up to a day before the end."""
    kind = F.when(F.col("rel") == "purchase", "guard").when(F.col("rel") == "signup", "witness").when(F.col("rel") == "error", "broken")
    rows = _event_stream(spark, sf_dir, "1 day").select("ts", "tp", F.col("user").alias("key"), kind.alias("kind")).filter("kind IS NOT NULL AND key IS NOT NULL")
    return _ended(spark, live.since_unbroken(rows, 2 * DAY)).withColumnRenamed("key", "u")


def merge_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.merged_heavy(stats_heavy(spark, sf_dir))


def hist_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return stats.merged_histograms(stats.histogram(f.filter("tp % 2 = 0")), stats.histogram(f.filter("tp % 2 = 1")))


def hist_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.frequent(stats.histogram(facts(spark, sf_dir)), 64)


def cut_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cut(facts(spark, sf_dir), 1704153600, 1704240000).select("tp", "ts", "rel")


def running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.running(stats_rel_freq(spark, sf_dir), "count", "rel", "start")


def sliding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sliding_frames(stats_rel_freq(spark, sf_dir), 3, DAY)


def verdict_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.verdict_lines(monitor("purchase(u,e) AND u < 10", events_trace(spark, sf_dir)), ("u", "e"))


def trace_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = formats.write_csv_trace(facts(spark, sf_dir)).withColumnRenamed("line", "value")
    return formats.read_csv_trace(lines).select("tp", "ts", "rel", F.array_join("args", "|").alias("args"))


def trace_database_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    lines = formats.write_database_trace(f, f.select("tp", "ts").distinct()).select(F.col("tp").alias("pos"), F.col("line").alias("value"))
    back, _ = formats.read_database_trace(lines)
    return back.select("tp", "ts", "rel", F.array_join("args", "|").alias("args"))


def linearize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(seconds("o_orderdate").alias("ts"), F.concat(F.lit("ord_"), "o_orderstatus").alias("rel"), F.array(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("args"))
    return formats.linearised(rows.withColumn("tp", F.col("ts"))).select("tp", "ts", "rel", F.array_join("args", "|").alias("args"))


def reorder_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reorder.restored(reorder.emitted(facts(spark, sf_dir))).select("pos", "tp", "ts", "rel")


def watermark_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reorder.late(reorder.emitted(facts(spark, sf_dir)), 600).select("tp", "ts", "rel")


_EMITTED = "m AS (SELECT *, ts + (tp * 7919) % 1200 AS emission FROM e)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _policy(n) for n in POLICIES} | {
    f.__name__: f
    for f in (slice_assign, slice_load, verdict_filter, relevant_facts, slicing_costs, share_opt, share_plan, stats_rel_freq, stats_slices, stats_heavy, stats_lines, stats_heavy_counts, split_statistics, sliding_values, latency_stats, reorder_collapsed, gap_seconds, stream_once_join, stream_reorder, stream_collapsed, stream_since, merge_heavy, hist_merge, hist_frequent, cut_log, running_max, sliding_frames, verdict_text, trace_csv_roundtrip, trace_database_roundtrip, linearize, reorder_total, watermark_late)
}

_FREQ = f"{_E}, f AS (SELECT CAST(ts // {DAY} * {DAY} AS BIGINT) AS start, rel, count(*) AS count FROM e GROUP BY ALL)"
_HEAVY = f"{_FREQ}, a AS (SELECT CAST(ts // {DAY} * {DAY} AS BIGINT) AS start, rel, 0 AS attribute, u AS value FROM e UNION ALL SELECT CAST(ts // {DAY} * {DAY} AS BIGINT), rel, 1, e FROM e), h AS (SELECT start, rel, CAST(attribute AS INTEGER) AS attribute, value, n AS count, f.count AS total FROM (SELECT start, rel, attribute, value, count(*) AS n FROM a GROUP BY ALL) JOIN f USING (start, rel) WHERE n >= greatest(ceil(f.count / 32.0), 2))"
_SEARCH = "s AS (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS i), k AS (SELECT x.i AS x, y.i AS y, z.i AS z FROM s x, s y, s z WHERE x.i * y.i * z.i <= 64)"
_COST = "a / x / y + b / y / z + c / x / z, greatest(x, y, z), x, y, z"
_HIST = f"{_E}, a AS (SELECT rel, tp % 2 AS half, 0 AS attribute, u AS value FROM e UNION ALL SELECT rel, tp % 2, 1, e FROM e)"
SQL: dict[str, str] = {n: definition_sql(p, _TRACES[t][1], g) for n, (t, p, g) in POLICIES.items()} | {
    "slice_assign": _slice_sql(),
    "slice_load": f"SELECT slice, count(*) AS events FROM ({_slice_sql()}) GROUP BY slice",
    "relevant_facts": f"WITH {_E} SELECT tp, ts, rel FROM e WHERE rel = 'view' OR rel = 'purchase' AND u = '7'",
    "slicing_costs": f"WITH {_E}, d AS (SELECT 'one' AS slicer, 0 AS slice FROM e WHERE rel IN ('view', 'purchase', 'error') UNION ALL SELECT 'users', (((CAST(u AS BIGINT) * 7919 + {_seed('u')} * 104729) % 4) + 4) % 4 FROM e WHERE rel IN ('view', 'purchase') UNION ALL SELECT 'users', r FROM e, (SELECT unnest(range(4)) AS r) WHERE rel = 'error') SELECT slicer, max(n) AS cost FROM (SELECT slicer, slice, count(*) AS n FROM d GROUP BY ALL) GROUP BY slicer",
    "share_opt": f"WITH {_E}, n AS (SELECT CAST(count(*) FILTER (rel = 'view') AS DOUBLE) AS a, CAST(count(*) FILTER (rel = 'purchase') AS DOUBLE) AS b, CAST(count(*) FILTER (rel = 'error') AS DOUBLE) AS c FROM e), {_SEARCH} SELECT d AS degree, variable, share FROM (SELECT CAST(d AS INTEGER) AS d, x, y, z FROM n, (VALUES (8), (64)) t(d), k WHERE x * y * z <= d QUALIFY row_number() OVER (PARTITION BY d ORDER BY {_COST}) = 1) UNPIVOT (share FOR variable IN (x, y, z))",
    "share_plan": f"WITH {_E}, w AS (SELECT CAST(ts // {DAY} * {DAY} AS BIGINT) AS start, CAST(count(*) FILTER (rel = 'view') AS DOUBLE) AS a, CAST(count(*) FILTER (rel = 'purchase') AS DOUBLE) AS b, CAST(count(*) FILTER (rel = 'error') AS DOUBLE) AS c FROM e WHERE rel IN ('view', 'purchase', 'error') GROUP BY ALL), n AS (SELECT start, coalesce(lag(a) OVER o, a) AS a, coalesce(lag(b) OVER o, b) AS b, coalesce(lag(c) OVER o, c) AS c FROM w WINDOW o AS (ORDER BY start)), {_SEARCH} SELECT start, variable, share FROM (SELECT start, x, y, z FROM n, k WHERE x * y * z <= 8 QUALIFY row_number() OVER (PARTITION BY start ORDER BY {_COST}) = 1) UNPIVOT (share FOR variable IN (x, y, z))",
    "split_statistics": f"WITH {_HEAVY} SELECT f.start, f.rel, f.count, h.attribute, h.value FROM f LEFT JOIN h ON f.start = h.start AND f.rel = h.rel",
    "sliding_values": f"WITH {_FREQ}, v AS (SELECT CAST(ts // {DAY} * {DAY} AS BIGINT) AS start, rel, u AS value, count(*) AS n FROM e GROUP BY ALL) SELECT g.start, g.rel, CAST(0 AS INTEGER) AS attribute, g.value, CAST(sum(v.n) AS BIGINT) AS count FROM v g JOIN v ON v.rel = g.rel AND v.value = g.value AND v.start BETWEEN g.start - {2 * DAY} AND g.start GROUP BY ALL",
    "latency_stats": f"WITH {_E}, {_EMITTED}, o AS (SELECT emission + 3 AS second, max(emission + 3 - ts) AS peak, sum(emission + 3 - ts) AS total, count(*) AS n FROM m WHERE tp % 10 = 0 GROUP BY ALL) SELECT second, peak, max(peak) OVER w AS max_so_far, CAST(sum(total) OVER w AS DOUBLE) / sum(n) OVER w AS average_so_far FROM o WINDOW w AS (ORDER BY second ROWS UNBOUNDED PRECEDING)",
    "reorder_collapsed": f"WITH {_E} SELECT dense_rank() OVER (ORDER BY ts) - 1 AS tp, ts, rel, u || '|' || e AS args FROM e",
    "gap_seconds": f"WITH {_E} SELECT unnest(range(min(ts), max(ts) + 1)) AS ts FROM e WHERE tp < 200",
    "stream_once_join": f"WITH {_E} SELECT p.tp, CAST(p.u AS BIGINT) AS u, v.tp AS a FROM e p JOIN e v ON v.u = p.u AND v.tp <= p.tp AND p.ts - v.ts >= 0 AND p.ts - v.ts < {DAY} WHERE p.rel = 'purchase' AND v.rel = 'view'",
    "stream_reorder": f"WITH {_E} SELECT ts, tp, CAST(1 AS INTEGER) AS n, rel FROM e WHERE ts <= (SELECT max(ts) FROM e) - {DAY}",
    "stream_collapsed": f"WITH {_E} SELECT ts, CAST(count(*) AS INTEGER) AS n FROM e WHERE ts <= (SELECT max(ts) FROM e) - {DAY} GROUP BY ts",
    "stream_since": f"SELECT u, tp FROM ({definition_sql(POLICIES['since_neg'][1])}) WHERE ts <= (SELECT max(epoch_us(ts) // 1000000) FROM events WHERE event_type IN ('purchase', 'signup', 'error')) - {DAY}",
    "stats_rel_freq": f"WITH {_FREQ} SELECT * FROM f",
    "stats_slices": f"SELECT CAST(ts // {DAY} * {DAY} AS BIGINT) AS start, slice, rel, count(*) AS count FROM ({_slice_sql()}) GROUP BY ALL",
    "stats_heavy": f"WITH {_HEAVY} SELECT * FROM h",
    "stats_lines": f"WITH {_HEAVY}, g AS (SELECT start, rel, string_agg(value, ',' ORDER BY value) AS hitters FROM h GROUP BY start, rel), p AS (SELECT * FROM f UNION ALL SELECT start, '', sum(count) FROM f GROUP BY start) SELECT p.start, p.rel, p.start || ',' || p.rel || ',' || p.count || coalesce(';' || hitters, '') AS line FROM p LEFT JOIN g ON p.start = g.start AND p.rel = g.rel",
    "stats_heavy_counts": f"WITH {_HEAVY}, g AS (SELECT start, rel, string_agg(value || ':' || count, ',' ORDER BY value || ':' || count) AS hitters FROM h GROUP BY start, rel) SELECT f.start, f.rel, f.start || ',' || f.rel || ',' || f.count || coalesce(';' || hitters, '') AS line FROM f LEFT JOIN g ON f.start = g.start AND f.rel = g.rel",
    "merge_heavy": f"WITH {_HEAVY} SELECT rel, attribute, value, count(DISTINCT start) AS windows FROM h GROUP BY ALL HAVING count(DISTINCT start) >= 2",
    "hist_merge": f"WITH {_HIST}, r AS (SELECT rel, tp % 2 AS half, count(*) AS n FROM e GROUP BY ALL), x AS (SELECT rel, half, attribute, value, count(*) AS c FROM a GROUP BY ALL) SELECT rel, CAST(attribute AS INTEGER) AS attribute, value, CAST(sum(c) AS BIGINT) AS cnt, CAST(sum(n) AS BIGINT) AS rel_cnt FROM x JOIN r USING (rel, half) GROUP BY ALL",
    "hist_frequent": f"WITH {_HIST}, r AS (SELECT rel, count(*) AS rel_cnt FROM e GROUP BY ALL) SELECT rel, CAST(attribute AS INTEGER) AS attribute, value, cnt, rel_cnt FROM (SELECT rel, attribute, value, count(*) AS cnt FROM a GROUP BY ALL) JOIN r USING (rel) WHERE cnt * 128 > rel_cnt",
    "cut_log": f"WITH {_E} SELECT tp, ts, rel FROM e WHERE ts >= 1704153600 AND ts < 1704240000",
    "running_max": f"WITH {_FREQ} SELECT *, max(count) OVER w AS max_so_far, avg(count) OVER w AS mean_so_far FROM f WINDOW w AS (PARTITION BY rel ORDER BY start ROWS UNBOUNDED PRECEDING)",
    "sliding_frames": f"WITH {_FREQ} SELECT g.start, g.rel, CAST(sum(f.count) AS BIGINT) AS count FROM f g JOIN f ON f.rel = g.rel AND f.start BETWEEN g.start - {2 * DAY} AND g.start GROUP BY ALL",
    "verdict_text": f"WITH {_E} SELECT tp, '@' || ts || '. (time point ' || tp || '): (' || u || ',' || e || ')' AS line FROM e WHERE rel = 'purchase' AND CAST(u AS BIGINT) < 10",
    "trace_csv_roundtrip": f"WITH {_E} SELECT tp, ts, rel, u || '|' || e AS args FROM e",
    "trace_database_roundtrip": f"WITH {_E} SELECT tp, ts, rel, u || '|' || e AS args FROM e",
    "linearize": "SELECT row_number() OVER (ORDER BY ts, rel, a, b) - 1 AS tp, ts, rel, a || '|' || b AS args FROM (SELECT epoch_us(o_orderdate) // 1000000 AS ts, 'ord_' || o_orderstatus AS rel, CAST(o_custkey AS VARCHAR) AS a, CAST(o_orderkey AS VARCHAR) AS b FROM orders)",
    "verdict_filter": f"SELECT tp, ts, 'user ' || u AS u, a, b, c FROM ({definition_sql(STAR)})",
    "reorder_total": f"WITH {_E} SELECT row_number() OVER (ORDER BY tp) - 1 AS pos, tp, ts, rel FROM e",
    "watermark_late": f"WITH {_E}, {_EMITTED}, w AS (SELECT *, max(ts) OVER (ORDER BY emission, tp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600 AS mark FROM m) SELECT tp, ts, rel FROM w WHERE ts < mark",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who viewed within a day before a purchase and met an error within a day after it."""
    return QUERIES["star_neg"](spark, sf_dir)
