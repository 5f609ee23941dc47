import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tempolog.operators import slicing, stats
from tempolog.plans.compile import monitor
from tempolog.plans.formula import parse
from tempolog.sources import formats, generate
from tempolog.sources.trace import from_facts, read_signature


def test_shares():
    triangle = parse("(A(x,y) AND B(y,z)) AND C(z,x)")
    assert slicing.optimal_shares(triangle, {}, 512) == {"x": 8, "y": 8, "z": 8}
    assert slicing.optimal_shares(triangle, {}, 65) == {"x": 4, "y": 4, "z": 4}
    assert slicing.optimal_shares(parse("A(x) AND B(y)"), {"A": 100, "B": 400}, 1024) == {"x": 16, "y": 64}
    s = slicing.Slicer.of(parse("A(x,y) AND B(y,x)"), {}, 8, {"x": (3,)})
    assert slicing.Slicer.loads(s.dumps()) == s


def test_every_verdict_has_a_slice_with_its_facts(spark):
    s = slicing.Slicer.of(parse("A(x,y) AND B(y,z)"), {}, 8, {"y": (1,)})
    rows = [(0, 0, n, [str(a), str(b)]) for n in "AB" for a in range(4) for b in range(4)]
    facts = spark.createDataFrame(rows, "tp bigint, ts bigint, rel string, args array<string>")
    dealt = s.assign(facts).select("rel", "slice", F.col("args")[0].cast("bigint").alias("a"), F.col("args")[1].cast("bigint").alias("b"))
    left = dealt.filter("rel = 'A'").select("slice", F.col("a").alias("x"), F.col("b").alias("y"))
    right = dealt.filter("rel = 'B'").select("slice", F.col("a").alias("y"), F.col("b").alias("z"))
    kept = s.canonical(left.join(right, ["slice", "y"]))
    assert kept.count() == kept.select("x", "y", "z").distinct().count() == 64


def test_formats(spark):
    lines = spark.createDataFrame([(0, '@10 p(a,"b c")(d,e) q()'), (1, "@10"), (2, "@12 q() # note"), (3, ">cmd x<")], "pos int, value string")
    facts, points = formats.read_database_trace(lines)
    assert sorted((r.tp, r.rel, tuple(r.args)) for r in facts.collect()) == [(0, "p", ("a", "b c")), (0, "p", ("d", "e")), (0, "q", ()), (2, "q", ())]
    assert sorted(map(tuple, points.collect())) == [(0, 10), (1, 10), (2, 12)]
    text = {r.tp: r.line for r in formats.write_database_trace(facts, points).collect()}
    assert text == {0: '@10 p("b c")(d,e) q()'.replace('p("b c")', 'p(a,"b c")'), 1: "@10", 2: "@12 q()"}
    csv = spark.createDataFrame([("ab, tp = 1, ts = 11, x = y",), (";;",), (">cmd 1<",)], "value string")
    assert [tuple(r) for r in formats.read_csv_trace(csv).collect()] == [(1, 11, "ab", ["y"])]
    events = spark.createDataFrame([(0, "p,a,5"), (1, "q,7")], "pos int, value string")
    assert sorted((r.tp, r.ts, r.rel, tuple(r.args)) for r in formats.read_event_trace(events, True).collect()) == [(0, 5, "p", ("a",)), (1, 7, "q", ())]
    verdict = spark.createDataFrame([("@456. (time point 1002): (abc)(def)",), ("@5. (time point 1): true",)], "value string")
    assert sorted((r.tp, r.ts, tuple(r.args)) for r in formats.read_verdicts(verdict).collect()) == [(1, 5, ()), (1002, 456, ("abc",)), (1002, 456, ("def",))]


def lines_of(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "pos int, value string")


def read(spark, *lines, **options):
    facts, points = formats.read_database_trace(lines_of(spark, *lines), **options)
    return sorted((r.tp, r.ts, r.rel, tuple(r.args)) for r in facts.collect()), sorted(map(tuple, points.collect()))


def test_databases_over_lines(spark):
    """Databases span lines and share them; what can't be read goes as a whole."""
    got = read(spark, "@123 @ 456 a b () ", ";", "@ 456 abc()() def1(123", ")", "", '(foo) def2([foo],"(bar)") ( a1 , " 2b ")', " @789")
    assert got == ([(1, 456, "b", ()), (2, 456, "abc", ()), (2, 456, "abc", ()), (2, 456, "def1", ("123",)), (2, 456, "def1", ("foo",)), (2, 456, "def2", ("[foo]", "(bar)")), (2, 456, "def2", ("a1", " 2b "))], [(0, 123), (1, 456), (2, 456), (3, 789)])
    assert read(spark, '@1 p(q) >foo "bar <" 123<', '@2 p("a@b") # @3 p()')[0] == [(0, 1, "p", ("q",)), (1, 2, "p", ("a@b",))]
    for bad in ("@ @", "@123 foo(,)", "@123 foo(bar)("):
        assert read(spark, bad, "@5 p()") == ([(0, 5, "p", ())], [(0, 5)])
    with pytest.raises(Exception, match="can't read"):
        read(spark, "@123 foo(,)", strict=True)
    commands = formats.read_commands(lines_of(spark, ">foo<", '@1 p(q) >foo "bar <" 123<')).collect()
    assert [(r.pos, r.name, r.args) for r in commands] == [(0, "foo", []), (1, "foo", ["bar <", "123"])]


def test_csv_lines(spark):
    lines = lines_of(spark, "", "  \t \r", "a,tp=1,ts=11", "ab, tp = 1, ts = 11, x = y", ";;", " cde , tp = 2 , ts = 11 , x =  y\r", "a, tp=2, ts=12, x=y, 123 = 4Foo56   ", "a, tp=3, ts=12", "abc", "abc, foo=bar", "abc, tp=1, ts=1, foo, bar", "abc, tp=x, ts=1")
    assert [tuple(r) for r in formats.read_csv_trace(lines).collect()] == [(1, 11, "a", []), (1, 11, "ab", ["y"]), (2, 11, "cde", ["y"]), (2, 12, "a", ["y", "4Foo56"]), (3, 12, "a", [])]
    with pytest.raises(Exception, match="can't read"):
        formats.read_csv_trace(lines, strict=True).collect()
    closed = lambda mode: {tuple(r) for r in formats.terminators(lines, mode).collect()}
    assert closed("all") == {(4, 1, 11), (6, 2, 11), (7, 2, 12), (None, 3, 12)}
    assert closed("timestamps") == {(4, 1, 11), (6, 2, 11), (None, 3, 12)}
    assert closed("none") == {(4, 1, 11), (None, 3, 12)}
    facts = spark.createDataFrame([(5, 1, "p", ["a"]), (9, 2, "q", [])], "tp bigint, ts bigint, rel string, args array<string>")
    assert sorted(r.line for r in formats.write_csv_trace(facts, True, True).collect()) == [";;", ";;", "p, tp=0, ts=1, x0=a", "q, tp=1, ts=2"]
    with pytest.raises(Exception, match="several events"):
        formats.write_event_trace(facts.union(facts)).collect()


def test_heavy_hitters(spark):
    facts = spark.createDataFrame([(i, i, "p", ["a" if i < 8 else str(i)]) for i in range(16)], "tp bigint, ts bigint, rel string, args array<string>")
    assert [(r.value, r["count"], r.total) for r in stats.heavy_hitters(facts, 60, 1, 2).collect()] == [("a", 8, 16)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_slices_apart_and_together(spark):
    policy = parse("(A(x,y) AND ONCE [0,9) B(y,z)) AND NOT ONCE [0,3) C(y)")
    rows = [(i, i // 2, n, [f"v{(i * k + j) % 5}" for j in range(1 if n == "C" else 2)]) for i in range(40) for k, n in enumerate("ABC", 1) if (i + k) % 3]
    facts = spark.createDataFrame(rows, "tp bigint, ts bigint, rel string, args array<string>")
    points = spark.createDataFrame([(i, i // 2) for i in range(40)], "tp bigint, ts bigint")
    sig = {"A": ("string", "string"), "B": ("string", "string"), "C": ("string",)}
    want = sorted(map(tuple, monitor(policy, from_facts(facts, points, sig)).collect()))
    for s in (slicing.Slicer.of(policy, {}, 8, {"y": ("v1", "v3")}), slicing.Slicer.fixed(policy, "x=2, z=3")):
        assert sorted(map(tuple, s.verdicts(facts, points, sig).collect())) == want and want
    assert slicing.Slicer.fixed(policy, "x=2,z=3").describe() == "heavy {}: x=2, y=1, z=3"
    dealt = slicing.by_slice(slicing.Slicer.fixed(policy, "x=2,z=3").assign(facts), 6).select("slice", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(dealt) == 6 and all(r.slice == r.p for r in dealt)
    with pytest.raises(ValueError):
        slicing.Slicer.fixed(policy, "w=2")


def test_decisions():
    one, two = (slicing.Slicer.fixed(parse("A(x)"), f"x={n}") for n in (1, 2))
    d = slicing.Decider(one, adapt_cost=100)
    assert [d.step(two, 120, 60), d.step(two, 120, 60)] == [False, True] and d.current == two


def test_generated_traces(spark):
    rows = generate.pattern_trace(spark, "star", 20, 300, zipf={"w": 2.0}).filter("rel = 'A'").groupBy(F.col("args")[0]).count().agg(F.max("count"), F.sum("count")).first()
    assert rows[0] > rows[1] / 4
    trace = generate.signature_trace(spark, read_signature("p(int) q(int,string) r()"), 10, 100)
    assert trace.count() == 1000 and {(r.rel, r.n) for r in trace.select("rel", F.size("args").alias("n")).distinct().collect()} == {("p", 1), ("q", 2), ("r", 0)}
    late = generate.delayed(generate.partitioned(trace, (1.0, 3.0)), 2.0, 3.0).cache()
    assert late.filter("emission < ts OR emission > ts + 3").count() == 0
    marks = generate.watermarks(late, 2)
    both = marks.select("part", F.col("emission").alias("at"), F.col("ts").alias("mark")).join(late, "part")
    assert both.filter("emission >= at AND ts <= mark").count() == 0 and marks.count() > 2
    assert {r.line for r in generate.start_lines(late).collect()} == {">START 0<"}
