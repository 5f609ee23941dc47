"""Policies to DataFrame plans.

A formula becomes a table (tp, ts, one column for each free variable) without duplicates. Conjunctions are ordered so
that relations come first. A temporal conjunct that brings no new variables is merged with what is already there (the
guard) in the order of time, so that each row meets its nearest witness only; one with new variables is joined to it on
the shared variables and buckets of time. Nothing is materialised over all time-points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import PLACES, latest, latest_within
from ..sources.trace import Trace
from .formula import INF, TRUE, Const, Formula, Interval, PolicyError, Var, neg, normalised, parse

_RELATIONS = ("pred", "exists", "previous", "next", "true", "false")
_PAST = ("once", "since")
_WITNESSED = ("once", "since", "eventually", "until")


def _flat(f: Formula) -> list[Formula]:
    return [x for a in f.args for x in _flat(a)] if f.kind == "and" else [f]


def _cols(f: Formula) -> list[str]:
    return [f"v_{v}" for v in f.variables()]


def _vars(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("v_")]


class Compiler:
    def __init__(self, trace: Trace) -> None:
        self.trace = trace

    # -- tables ---------------------------------------------------------------------------------------------------------
    def sat(self, f: Formula) -> DataFrame:
        """All satisfying assignments of a formula that needs no guard."""
        if f.kind in ("pred", "true", "false", "exists", "previous", "next"):
            return getattr(self, f"_{f.kind}")(f)
        if f.kind == "or":
            a, b = f.args
            if set(a.variables()) != set(b.variables()):
                raise PolicyError(f"the sides of OR have different free variables: {f}")
            return self.sat(a).unionByName(self.sat(b)).distinct()
        if f.kind == "eq" and sum(isinstance(t, Const) for t in f.terms) == 1:
            return self.conjunction([TRUE, f])
        if f.kind == "not" and not f.variables():
            return self.trace.timepoints.join(self.sat(f.args[0]), "tp", "left_anti")
        return self.conjunction(_flat(f))

    def conjunction(self, parts: list[Formula]) -> DataFrame:
        parts = [p for p in parts if p != TRUE] or [TRUE]
        first = [p for p in parts if p.kind in _RELATIONS] or [p for p in parts if p.kind == "or" and self._safe(p)] or [p for p in parts if p.kind in _WITNESSED][:1]
        if not first:
            out, left = self.trace.timepoints, parts
        else:
            first.sort(key=lambda p: -len(p.variables()))
            start = first[0]
            left = [p for p in parts if p is not start]
            out = self._witness_guarded(self.trace.timepoints, start) if start.kind in _WITNESSED else self.sat(start)
        while left:
            bound = set(_vars(out))
            ready = [p for p in left if self._ready(p, bound)]
            if not ready:
                raise PolicyError("can't be evaluated over finite tables: " + " AND ".join(f"({p})" for p in left))
            p = min(ready, key=lambda p: self._rank(p, bound))
            out = self.guarded(out, p)
            left.remove(p)
        return out

    def _safe(self, f: Formula) -> bool:
        """Whether sat can evaluate a formula, told from the formula alone."""
        if f.kind in ("pred", "true", "false"):
            return True
        if f.kind in ("exists", "previous", "next", "once", "eventually"):
            return self._safe(f.args[0])
        if f.kind == "or":
            return set(f.args[0].variables()) == set(f.args[1].variables()) and all(map(self._safe, f.args))
        if f.kind in ("since", "until"):
            left, right = f.args
            return set(left.variables()) <= set(right.variables()) and self._safe(neg(left) if left.kind == "not" else left) and self._safe(right)
        if f.kind == "eq":
            return sum(isinstance(t, Const) for t in f.terms) == 1
        if f.kind == "not" and not f.variables():
            return self._safe(f.args[0])
        if f.kind != "and":
            return not f.variables() and f.kind in ("historically", "always", "trigger", "release")
        parts, bound = _flat(f), set()
        start = [p for p in parts if p.kind in (*_RELATIONS, "or", *_WITNESSED) and self._safe(p)]
        bound = set(_cols(start[0])) if start else set()
        left = [p for p in parts if not start or p is not start[0]]
        while left:
            ready = [p for p in left if self._ready(p, bound) and (p.kind not in (*_RELATIONS, *_WITNESSED) or self._safe(p))]
            if not ready:
                return False
            bound |= set(_cols(ready[0]))
            left.remove(ready[0])
        return True

    def _ready(self, p: Formula, bound: set[str]) -> bool:
        own = set(_cols(p))
        if p.kind == "eq":
            return len(own - bound) == 0 or len(own - bound) == 1 and (len(p.terms) - len([t for t in p.terms if isinstance(t, Var) and f"v_{t.name}" not in bound]) == 1)
        if p.kind in ("less", "not", "historically", "always", "trigger", "release"):
            return own <= bound
        return True

    def _rank(self, p: Formula, bound: set[str]) -> tuple[int, int]:
        order = 0 if p.kind in ("eq", "less") else 1 if p.kind in _RELATIONS else 2 if p.kind in _WITNESSED else 3 if p.kind == "not" else 4
        return order, -len(bound & set(_cols(p)))

    def guarded(self, guard: DataFrame, p: Formula) -> DataFrame:
        """The rows of a guard that satisfy a conjunct, with the conjunct's further variables."""
        own, bound = _cols(p), _vars(guard)
        if p.kind in ("eq", "less"):
            return self._compared(guard, p)
        if p.kind == "not" and p.args[0].kind in ("eq", "less"):
            return guard.filter(~self._comparison(p.args[0]))
        bare = p.args[0] if p.kind == "not" else p
        if bare.kind == "exists" and set(own) <= set(bound) and not self._safe(bare):
            # the body needs the guard's variables
            names = {f"v_{bare.name}"} & set(bound)
            if names:
                raise PolicyError(f"the variable {bare.name} is bound twice")
            found = self.guarded_all(guard, _flat(bare.args[0])).select(guard.columns).distinct()
            return guard.join(found, guard.columns, "left_anti") if p.kind == "not" else found
        if p.kind == "not":
            inner = p.args[0]
            if inner.kind in _WITNESSED:
                return self._witness_guarded(guard, inner, "left_anti")
            return guard.join(self.sat(inner), ["tp", *own], "left_anti")
        if p.kind in ("historically", "always"):
            body = p.args[0]
            if body.kind in ("not", "eq", "less"):
                dual = Formula("once" if p.kind == "historically" else "eventually", (neg(body),), interval=p.interval)
                return self._witness_guarded(guard, dual, "left_anti")
            return self._throughout(guard, p)
        if p.kind in ("trigger", "release"):
            dual = Formula("since" if p.kind == "trigger" else "until", tuple(map(neg, p.args)), interval=p.interval)
            return self._witness_guarded(guard, dual, "left_anti")
        if p.kind in _WITNESSED:
            return self._witness_guarded(guard, p, "left_semi" if set(own) <= set(bound) else "inner")
        if p.kind == "or":
            sides = [self.guarded_all(guard, _flat(a)) for a in p.args]
            if set(sides[0].columns) != set(sides[1].columns):
                raise PolicyError(f"the sides of OR have different free variables: {p}")
            return sides[0].unionByName(sides[1]).distinct()
        if p.kind == "and":
            return self.guarded_all(guard, _flat(p))
        other = self.sat(p)
        shared = ["tp", *[c for c in own if c in bound]]
        return guard.join(other.drop("ts"), shared, "left_semi" if set(own) <= set(bound) else "inner")

    def guarded_all(self, guard: DataFrame, parts: list[Formula]) -> DataFrame:
        while parts:
            bound = set(_vars(guard))
            ready = [p for p in parts if self._ready(p, bound)]
            if not ready:
                raise PolicyError("can't be evaluated over finite tables: " + str(parts[0]))
            p = min(ready, key=lambda p: self._rank(p, bound))
            guard = self.guarded(guard, p)
            parts = [x for x in parts if x is not p]
        return guard

    # -- atoms ----------------------------------------------------------------------------------------------------------
    def _pred(self, f: Formula) -> DataFrame:
        rel = self.trace.relation(f.name)
        columns = [c for c in rel.columns if c not in ("tp", "ts")]
        if len(columns) != len(f.terms):
            raise PolicyError(f"{f.name} has {len(columns)} arguments")
        names: dict[str, str] = {}
        for c, t in zip(columns, f.terms, strict=True):
            if isinstance(t, Const):
                rel = rel.filter(F.col(c) == F.lit(t.value))
            elif t.name in names:
                rel = rel.filter(F.col(c) == F.col(names[t.name]))
            else:
                names[t.name] = c
        return rel.select("tp", "ts", *[F.col(c).alias(f"v_{v}") for v, c in names.items()]).distinct()

    def _true(self, f: Formula) -> DataFrame:
        return self.trace.timepoints

    def _false(self, f: Formula) -> DataFrame:
        return self.trace.timepoints.filter(F.lit(False))

    def _exists(self, f: Formula) -> DataFrame:
        inner = self.sat(f.args[0])
        return inner.drop(f"v_{f.name}").distinct()

    def _term(self, t: Var | Const) -> Column:
        return F.lit(t.value) if isinstance(t, Const) else F.col(f"v_{t.name}")

    def _comparison(self, f: Formula) -> Column:
        a, b = map(self._term, f.terms)
        return a == b if f.kind == "eq" else a < b

    def _compared(self, guard: DataFrame, f: Formula) -> DataFrame:
        free = [t for t in f.terms if isinstance(t, Var) and f"v_{t.name}" not in guard.columns]
        if not free:
            return guard.filter(self._comparison(f))
        other = next(t for t in f.terms if t is not free[0])
        return guard.withColumn(f"v_{free[0].name}", self._term(other))

    # -- time -----------------------------------------------------------------------------------------------------------
    def _within(self, gap: Column, i: Interval) -> Column:
        return (gap >= i.low) & (gap < i.high) if i.high is not INF else gap >= i.low

    def _previous(self, f: Formula, step: int = 1) -> DataFrame:
        inner = self.sat(f.args[0])
        moved = inner.select((F.col("tp") + step).alias("tp"), F.col("ts").alias("its"), *_vars(inner))
        return self.trace.timepoints.join(moved, "tp").filter(self._within((F.col("ts") - F.col("its")) * step, f.interval)).drop("its")

    def _next(self, f: Formula) -> DataFrame:
        return self._previous(f, -1)

    def _witnesses(self, f: Formula) -> DataFrame:
        """What the last argument's assignments reach: columns wtp, wts, far (the last time-point reached; for the future
        operators the first) and variables."""
        past = f.kind in _PAST
        q = self.sat(f.args[-1])
        names = _vars(q)
        if f.kind in ("once", "eventually"):
            return q.select(F.col("tp").alias("wtp"), F.col("ts").alias("wts"), F.lit(None).cast("bigint").alias("far"), *names)
        left = f.args[0]
        negative = left.kind == "not"
        p = self.sat(left.args[0] if negative else left)
        key = _vars(p)
        if not set(key) <= set(names):
            raise PolicyError(f"free variables of the left side must occur on the right: {f}")
        sign = 1 if past else -1
        at = F.col("tp") * sign
        if negative or not key:
            # the nearest time-point beyond the witness where the left side doesn't hold: the latest in reversed time
            broken = p if negative else self.trace.timepoints.join(p, "tp", "left_anti")
            if f.interval.high is INF:
                out = latest(q, broken, key, -at - 1, -at, -at, PLACES, "near")
            else:
                # what breaks after the interval has ended says nothing
                ts, reach = F.col("ts") * sign, f.interval.high
                out = latest_within(q, broken, key, -at - 1, -at, -at, ts, (ts - reach + 1, ts), reach, "near")
            return out.select(F.col("tp").alias("wtp"), F.col("ts").alias("wts"), ((-F.col("near") - 1) * sign).cast("bigint").alias("far"), *names)
        ends = self._runs(p, key, past).select((F.col("tp") - sign).alias("tp"), "end", *key)
        joined = q.join(ends, ["tp", *key], "left")
        return joined.select(F.col("tp").alias("wtp"), F.col("ts").alias("wts"), F.coalesce("end", "tp").alias("far"), *names)

    def _runs(self, p: DataFrame, key: list[str], forward: bool) -> DataFrame:
        """Each row of p with the last (or first) time-point of the run of neighbouring time-points that it lies in: column end."""
        runs = p.withColumn("run", F.col("tp") - F.row_number().over(Window.partitionBy(*key).orderBy("tp")))
        return runs.withColumn("end", (F.max if forward else F.min)("tp").over(Window.partitionBy("run", *key)))

    def _witness_guarded(self, guard: DataFrame, f: Formula, how: str = "inner") -> DataFrame:
        past, i = f.kind in _PAST, f.interval
        w = self._witnesses(f)
        bound, names = _vars(guard), _vars(w)
        if how != "inner" and not set(names) <= set(bound):
            raise PolicyError(f"unbound variables in {f}")
        if set(names) <= set(bound):
            return self._reached(guard, w, names, f, how == "left_anti")
        shared = [c for c in names if c in bound]
        columns = ["tp", "ts", *bound, *[F.col(f"w{c}").alias(c) for c in names if c not in bound]]
        w = w.select("wtp", "wts", "far", *[F.col(c).alias(f"w{c}") for c in names])
        sign = 1 if past else -1
        if f.kind in ("once", "eventually") and i.high is not INF:
            # spans of an assignment don't overlap: the result, which may be far larger than both sides, has no duplicates
            w = self._spans(w, [f"w{c}" for c in names], i, sign)
            on = (F.floor(F.col("ts") / (i.high - i.low)) == F.col("wbucket")) & F.col("ts").between(F.col("wfirst"), F.col("wlast")) & (F.col("tp") * sign >= F.col("wfrom"))
            for c in shared:
                on &= F.col(c) == F.col(f"w{c}")
            return guard.distinct().join(w, on).select(*columns)
        on = (F.col("wtp") <= F.col("tp") if past else F.col("wtp") >= F.col("tp")) & self._within((F.col("ts") - F.col("wts")) * sign, i)
        if f.kind not in ("once", "eventually"):
            on &= F.coalesce(F.col("tp") <= F.col("far") if past else F.col("tp") >= F.col("far"), F.lit(True))
        for c in shared:
            on &= F.col(c) == F.col(f"w{c}")
        if i.high is not INF:
            # time as a further equal key: a witness is dealt to the two or so buckets of time that it reaches
            width = i.high - i.low
            low, high = (F.col("wts") + i.low, F.col("wts") + i.high - 1) if past else (F.col("wts") - i.high + 1, F.col("wts") - i.low)
            w = w.withColumn("wbucket", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
            on &= F.floor(F.col("ts") / width) == F.col("wbucket")
        return guard.join(w, on).select(*columns).distinct()

    def _spans(self, w: DataFrame, names: list[str], i: Interval, sign: int) -> DataFrame:
        """The time that witnesses reach by ONCE or EVENTUALLY, for each assignment and bucket of time: spans that don't overlap
        (wfirst to wlast), with the least of their witnesses' time-points (of the negative ones for the future) as wfrom.

        Buckets are as wide as a witness's reach, which so either lasts to the bucket's end or began before it: running values
        from both sides give the witnesses of each span, in whatever order time-stamps come."""
        width = i.high - i.low
        first = F.col("wts") + i.low if sign > 0 else F.col("wts") - i.high + 1
        w = w.select(*names, (F.col("wtp") * sign).alias("p"), first.alias("first"))
        w = w.withColumn("wbucket", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + width - 1) / width))))
        start = F.col("wbucket") * width
        lasts = F.col("first") >= start
        w = w.select("*", F.when(lasts, F.col("first")).otherwise(F.col("first") + width).alias("at"), F.when(lasts, F.col("p")).alias("begun"), F.when(~lasts, F.col("p")).alias("ending"))
        key = Window.partitionBy(*names, "wbucket")
        order = key.orderBy("at")
        begun, ending = F.min("begun"), F.min("ending").over(key.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        before = begun.over(order.rowsBetween(Window.unboundedPreceding, -1))
        w = w.select("*", F.lag("at").over(order).alias("left"), F.lead("at").over(order).alias("right"), F.least(before, ending).alias("up_to"), F.least(before, F.col("begun")).alias("after"))
        # each row ends a span at its place; the bucket's last one begins another
        ends = F.struct(F.coalesce("left", start).alias("wfirst"), (F.col("at") - 1).alias("wlast"), F.col("up_to").alias("wfrom"))
        begins = F.struct(F.col("at").alias("wfirst"), (start + width - 1).alias("wlast"), F.when(F.col("right").isNull(), F.col("after")).alias("wfrom"))
        return w.select(*names, "wbucket", F.inline(F.array(ends, begins))).filter("wfirst <= wlast AND wfrom IS NOT NULL")

    def _reached(self, guard: DataFrame, w: DataFrame, names: list[str], f: Formula, absent: bool) -> DataFrame:
        """The rows of a guard that a witness with the same values reaches (or that none does).

        Of the witnesses at the interval's near end or beyond it the nearest decides: it is inside the far end if any is, and
        what holds since a further one holds since it too."""
        i, sign = f.interval, 1 if f.kind in _PAST else -1
        value = F.struct((F.col("wts") * sign).alias("s"), (F.col("wtp") * sign).alias("p"), (F.col("far") * sign).alias("far"))
        ts, wts = F.col("ts") * sign, F.col("wts") * sign
        at, when = (ts, wts + i.low) if i.low else (F.col("tp") * sign, F.col("wtp") * sign)
        if i.high is INF:
            out = latest(guard, w, names, at, when, value, 86400 if i.low else PLACES, "near")
        else:
            out = latest_within(guard, w, names, at, when, value, ts, (wts + i.low, wts + i.high - 1), i.high - i.low, "near")
        holds = F.col("near").isNotNull()
        if i.high is not INF:
            holds &= F.col("ts") * sign - F.col("near.s") < i.high
        if f.kind not in ("once", "eventually"):
            holds &= F.coalesce(F.col("tp") * sign <= F.col("near.far"), F.lit(True))
        return out.filter(~F.coalesce(holds, F.lit(False)) if absent else holds).select(*guard.columns)

    def _throughout(self, guard: DataFrame, f: Formula) -> DataFrame:
        """HISTORICALLY and ALWAYS of a positive formula: the window's nearest time-point lies in a run that reaches its furthest.

        Windows depend on the time-point only; they are found once for each and joined by equal time-points."""
        past, i = f.kind == "historically", f.interval
        p = self.sat(f.args[0])
        key = _vars(p)
        if not set(key) <= set(_vars(guard)):
            raise PolicyError(f"unbound variables in {f}")
        if not key:
            dual = Formula("once" if past else "eventually", (Formula("not", (f.args[0],)),), interval=i)
            return self._witness_guarded(guard, dual, "left_anti")
        sign = 1 if past else -1
        points = self.trace.timepoints
        at, width, reversed_tp = F.col("ts") * sign, min(i.high or 86400, 86400), F.col("tp") * sign
        window = points.withColumn("near", reversed_tp) if not i.low else latest(points, points, [], at, at + i.low, reversed_tp, width, "near")
        if i.high is INF:
            window = window.withColumn("beyond", F.lit(None).cast("bigint"))
        else:
            window = latest(window, points, [], at, at + i.high, reversed_tp, width, "beyond")
        # without a time-point beyond the window reaches to the end of the trace
        if past:
            far = F.coalesce(F.col("beyond") + 1, F.lit(0))
        else:
            window = window.crossJoin(F.broadcast(points.agg((-F.max("tp")).alias("last"))))
            far = F.coalesce(F.col("beyond") + 1, F.col("last"))
        window = window.select("tp", (F.col("near") * sign).alias("near"), (far * sign).alias("far"))
        runs = self._runs(p, key, not past).select(F.col("tp").alias("near"), "end", *key)
        out = guard.join(window, "tp").join(runs, ["near", *key], "left")
        empty = F.col("near").isNull() | ((F.col("near") - F.col("far")) * sign < 0)
        held = (F.col("far") - F.col("end")) * sign >= 0
        return out.filter(empty | F.coalesce(held, F.lit(False))).select(*guard.columns)


def monitor(policy: str | Formula, trace: Trace, negate: bool = False, complete: bool = True) -> DataFrame:
    """Verdicts: tp, ts and a column for each free variable, in order of their first occurrence, without duplicates.

    negate reports the assignments that violate the policy. With complete=False only time-points whose future windows have
    passed by the end of the trace are reported, as a running monitor would.
    """
    f = parse(policy) if isinstance(policy, str) else policy
    names = f.variables()
    g = normalised(f, negate)
    g = _guardable(g)
    out = Compiler(trace).sat(g)
    if not complete:
        reach = horizon(g)
        if reach is INF:
            return out.filter(F.lit(False)).select("tp", "ts", *[F.col(f"v_{v}").alias(v) for v in names])
        last = trace.timepoints.agg(F.max("ts").alias("last"))
        out = out.join(F.broadcast(last), F.col("ts") + reach < F.col("last")) if reach else out
    return out.select("tp", "ts", *[F.col(f"v_{v}").alias(v) for v in names])


def _guardable(f: Formula) -> Formula:
    """FORALL as NOT EXISTS NOT, and a conjunction as the whole where only guarded conjuncts stand alone."""
    args = tuple(_guardable(a) for a in f.args)
    f = Formula(f.kind, args, f.terms, f.name, f.interval)
    if f.kind == "forall":
        inner = normalised(args[0], True)
        return Formula("not", (_guardable(Formula("exists", (inner,), name=f.name)),))
    return f


def horizon(f: Formula) -> int | None:
    """How far into the future a formula looks; None without bound."""
    own = 0
    if f.kind in ("eventually", "always", "until", "release", "next"):
        if f.interval.high is INF:
            return INF
        own = f.interval.high - 1
    inner = [horizon(a) for a in f.args]
    return INF if INF in inner else own + max(inner, default=0)



