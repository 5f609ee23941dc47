"""Plans against the definitions, on random traces with repeated time-stamps."""

import itertools
import random

import pytest

from tempolog.plans.compile import monitor
from tempolog.plans.formula import Const, parse
from tempolog.plans.formula import PolicyError
from tempolog.sources.trace import from_facts, read_signature

POLICIES = [
    "q(x) AND ONCE [0,3) p(x)", "q(x) AND ONCE [1,4) p(x)", "q(x) AND ONCE [2,*) p(x)", "ONCE [0,2) p(x)",
    "q(x) AND EVENTUALLY [1,4) p(x)", "p(x) SINCE [0,4) q(x)", "p(x) SINCE [1,*) q(x)", "(NOT p(x)) SINCE [0,3) q(x)",
    "p(x) UNTIL [0,4) q(x)", "(NOT p(x)) UNTIL [1,4) q(x)", "q(x) AND HISTORICALLY [0,3) p(x)", "q(x) AND ALWAYS [1,3) p(x)",
    "q(x) AND HISTORICALLY [0,2) NOT p(x)", "PREV [0,2) p(x)", "NEXT [0,2) p(x)", "q(x) AND (p(x) OR ONCE [0,2) p(x))",
    "q(x) AND NOT ((NOT p(x)) SINCE [0,3) q(x))", "NOT (EXISTS x. p(x))", "q(x) AND NOT x = 1", "q(x) AND ONCE [0,3) p(y)",
    "q(x) AND FORALL y. (p(y) IMPLIES y < x)", "q(x) AND (p(x) TRIGGER [0,2) NOT p(x))",
    "q(x) AND HISTORICALLY [1,*) p(x)", "q(x) AND ALWAYS [0,*) p(x)", "q(x) AND HISTORICALLY [0,3) (EXISTS y. p(y))", "q(x) AND ALWAYS [1,4) (EXISTS y. p(y))",
    "q(x) AND ((EXISTS y. p(y)) SINCE [1,4) (EXISTS z. q(z)))", "q(x) AND NOT ((EXISTS y. p(y)) UNTIL [0,3) p(x))", "q(x) AND ((EXISTS y. p(y)) SINCE [0,*) p(y))",
]


def holds(f, i, v, ts, db, domain):
    gap = lambda a, b: f.interval.low <= b - a and (f.interval.high is None or b - a < f.interval.high)
    at = lambda g, j: holds(g, j, v, ts, db, domain)
    n, k, a = len(ts), f.kind, f.args
    value = lambda t: t.value if isinstance(t, Const) else v[t.name]
    if k == "pred":
        return tuple(map(value, f.terms)) in db[i].get(f.name, ())
    if k in ("eq", "less"):
        x, y = map(value, f.terms)
        return x == y if k == "eq" else x < y
    if k in ("exists", "forall"):
        return (any if k == "exists" else all)(holds(a[0], i, v | {f.name: d}, ts, db, domain) for d in domain)
    if k == "not":
        return not at(a[0], i)
    if k == "implies":
        return not at(a[0], i) or at(a[1], i)
    if k in ("and", "or"):
        return (all if k == "and" else any)(at(x, i) for x in a)
    if k == "previous":
        return i > 0 and gap(ts[i - 1], ts[i]) and at(a[0], i - 1)
    if k == "next":
        return i + 1 < n and gap(ts[i], ts[i + 1]) and at(a[0], i + 1)
    past = [j for j in range(i + 1) if gap(ts[j], ts[i])]
    future = [j for j in range(i, n) if gap(ts[i], ts[j])]
    if k in ("once", "eventually"):
        return any(at(a[0], j) for j in (past if k == "once" else future))
    if k in ("historically", "always"):
        return all(at(a[0], j) for j in (past if k == "historically" else future))
    if k == "since":
        return any(at(a[1], j) and all(at(a[0], m) for m in range(j + 1, i + 1)) for j in past)
    if k == "until":
        return any(at(a[1], j) and all(at(a[0], m) for m in range(i, j)) for j in future)
    if k == "trigger":
        return all(at(a[1], j) or any(at(a[0], m) for m in range(j + 1, i + 1)) for j in past)
    raise ValueError(k)


@pytest.mark.parametrize("seed", range(2))
def test_policies(spark, seed):
    r = random.Random(seed)
    ts = sorted(r.randrange(8) for _ in range(9))
    db = [{n: {(x,) for x in range(3) if r.random() < 0.45} for n in "pq"} for _ in ts]
    points = spark.createDataFrame(list(enumerate(ts)), "tp bigint, ts bigint")
    facts = spark.createDataFrame([(i, ts[i], n, [str(x) for x in t]) for i, d in enumerate(db) for n in d for t in d[n]], "tp bigint, ts bigint, rel string, args array<string>")
    trace = from_facts(facts.cache(), points.cache(), read_signature("p(x:int) q(int)"))
    for text in POLICIES:
        f = parse(text)
        names = f.variables()
        want = {(i, ts[i], *v) for i in range(len(ts)) for v in itertools.product(range(3), repeat=len(names)) if holds(f, i, dict(zip(names, v)), ts, db, range(3))}
        got = [tuple(x) for x in monitor(text, trace).collect()]
        assert len(got) == len(set(got)) and set(got) == want, text


def test_unsafe(spark):
    points = spark.createDataFrame([(0, 0)], "tp bigint, ts bigint")
    facts = spark.createDataFrame([], "tp bigint, ts bigint, rel string, args array<string>")
    trace = from_facts(facts, points, read_signature("p(int)"))
    for text in ("NOT p(x)", "TRUE OR p(x)", "p(x) AND y < 3"):
        with pytest.raises(PolicyError):
            monitor(text, trace)
    assert monitor("p(x)", trace).count() == 0


def test_new_variables_without_duplicates(spark):
    """What ONCE and EVENTUALLY bring is not made distinct afterwards (it may be far larger than the trace), nor does it repeat."""
    r = random.Random(3)
    ts = [r.choice([*range(-4, 9), None]) for _ in range(40)]
    points = [(i, t) for i, t in enumerate(ts)] + [(5, ts[5])]
    rows = [(i, ts[i], n, [None if x == 3 else str(x)]) for i in range(40) for n in "pq" for x in range(4) if r.random() < 0.3]
    facts = spark.createDataFrame(rows + rows[:9], "tp bigint, ts bigint, rel string, args array<string>")
    trace = from_facts(facts, spark.createDataFrame(points, "tp bigint, ts bigint"), read_signature("p(x:int) q(int)"))
    for low, high in ((0, 3), (2, 7)):
        for word, sign in (("ONCE", 1), ("EVENTUALLY", -1)):
            known = [(i, t) for i, t in enumerate(ts) if t is not None]
            meets = {(i, j) for i, t in known for j, s in known if (i - j) * sign >= 0 and low <= (t - s) * sign < high}
            value = lambda x: x[0] and int(x[0])
            p, q = ([(i, value(x)) for i, _, n, x in rows if n == name] for name in "pq")
            alone = {(i, ts[i], x) for j, x in p for i, k in meets if k == j}
            joined = {(i, ts[i], y, x) for j, x in p for i, y in q if (i, j) in meets}
            for text, want in ((f"{word} [{low},{high}) p(x)", alone), (f"q(y) AND {word} [{low},{high}) p(x)", joined)):
                out = monitor(text, trace)
                got = [tuple(x) for x in out.collect()]
                assert len(got) == len(set(got)) and set(got) == want, text
                plan = out._jdf.queryExecution().optimizedPlan().toString()
                assert "Join" in plan and "Aggregate" not in plan.split("Join")[0], text
