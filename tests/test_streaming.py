import pytest

from tempolog.streaming import live


def test_once_and_counts(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "view" if i % 2 else "buy", i % 4) for i in range(40)] + [(99, "2024-01-02 00:00:00", "end", 0)]
    d = spark.createDataFrame(rows, "id bigint, t string, rel string, user bigint").selectExpr("id", "CAST(t AS TIMESTAMP) AS ts", "rel", "user DIV 2 AS user")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "id bigint, ts timestamp, rel string, user bigint"
    stream = lambda: live.fact_stream(spark, str(tmp_path / "in"), schema)
    joined = live.once_within(stream().filter("rel = 'buy'"), stream().filter("rel = 'view'"), "user", 0, 300)
    live.run_to_end(joined, str(tmp_path / "out"), str(tmp_path / "c1"))
    got = {(r.id, r.w_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[2] == "buy" and b[2] == "view" and a[3] // 2 == b[3] // 2 and 0 <= a[0] - b[0] < 5}
    assert got == want
    live.run_to_end(live.relation_counts(stream(), "10 minutes"), str(tmp_path / "n"), str(tmp_path / "c2"))
    assert sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "n")).filter("rel <> 'end'").collect()) == [5] * 8


def test_reordering_and_late_facts(spark, tmp_path):
    at = "timestamp_seconds"
    rows = [(3, 30, "p", ["a"]), (1, 10, "p", ["b"]), (1, 10, "q", []), (2, 10, "p", ["c"]), (9, 1000, "p", [])]
    schema = "tp bigint, ts timestamp, rel string, args array<string>"
    make = lambda rs: spark.createDataFrame(rs, "tp bigint, s bigint, rel string, args array<string>").selectExpr("tp", f"{at}(s) AS ts", "rel", "args")
    make(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    for mode in ("total", "collapsed"):
        out = live.reordered(live.fact_stream(spark, str(tmp_path / "in"), schema, "60 seconds"), mode).selectExpr("unix_timestamp(ts) AS ts", "tp", "facts")
        run = lambda strict=False: live.run_to_end(out, str(tmp_path / mode), str(tmp_path / f"c-{mode}"), strict)  # noqa: E731, B023
        run()
        got = sorted(((r.ts, r.tp, [(f.rel, f.args) for f in r.facts]) for r in spark.read.parquet(str(tmp_path / mode)).collect()), key=str)
        one, two = [("p", ["b"]), ("q", [])], [("p", ["c"])]
        assert got == ([(10, 1, one), (10, 2, two), (30, 3, [("p", ["a"])])] if mode == "total" else [(10, None, [one[0], two[0], one[1]]), (30, None, [("p", ["a"])])])
    make([(4, 40, "p", ["late"]), (10, 1005, "p", [])]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="late"):
        run(True)
    assert spark.read.parquet(str(tmp_path / "collapsed")).filter("ts = 40").count() == 0


def test_since_goes_on_after_a_restart(spark, tmp_path):
    rows = [(0, 5, 1, "witness"), (1, 10, 1, "guard"), (2, 10, 2, "guard"), (3, 20, 1, "broken"), (4, 30, 1, "guard"), (5, 40, 1, "witness"), (9, 500, 3, "guard")]
    more = [(10, 530, 1, "guard"), (11, 700, 1, "guard"), (20, 2000, 3, "guard")]
    schema = "tp bigint, ts timestamp, key bigint, kind string"
    for part in (rows, more):
        spark.createDataFrame(part, "tp bigint, s bigint, key bigint, kind string").selectExpr("tp", "timestamp_seconds(s) AS ts", "key", "kind").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = live.since_unbroken(live.fact_stream(spark, str(tmp_path / "in"), schema, "0 seconds"), 600)
        live.run_to_end(out, str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted((r.key, r.tp) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (1, 10)]


def test_replay(spark, tmp_path):
    facts = spark.createDataFrame([(0, 100, "p"), (1, 104, "q")], "tp bigint, ts bigint, rel string")
    query = live.replayed(spark, facts, 4.0).writeStream.format("memory").queryName("replayed").start()
    query.awaitTermination(12)
    query.stop()
    assert sorted(r.tp for r in spark.table("replayed").collect()) == [0, 1]
