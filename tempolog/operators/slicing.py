"""Hypercube slicing: shares for the free variables of a policy, facts to slices, and one slice for each verdict."""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compile import monitor
from ..plans.formula import Const, Formula, PolicyError, Var
from ..sources.trace import from_facts
from .stats import relation_frequency


def optimal_shares(policy: Formula, sizes: dict[str, float], degree: int, pinned: frozenset[str] = frozenset()) -> dict[str, int]:
    """The shares with a product of at most `degree` that send the fewest facts to a slice; of equals the most even ones.

    An atom's facts are divided by the shares of its variables. Pinned variables keep the share 1. The search goes over
    all vectors of shares, one variable after another."""
    names = sorted(policy.variables())
    atoms = [(sizes.get(a.name, 1.0), [names.index(v) for v in dict.fromkeys(a.variables()) if v in names]) for a in policy.atoms()]

    def cost(shares: tuple[int, ...]) -> float:
        total = 0.0
        for size, used in atoms:
            for i in used:
                size /= shares[i]
            total += size
        return total

    def vectors(left: int, room: int):
        if not left:
            yield ()
            return
        name = names[len(names) - left]
        for s in range(1, 2 if name in pinned else room + 1):
            for rest in vectors(left - 1, room // s):
                yield (s, *rest)

    best = min(vectors(len(names), degree), key=lambda s: (cost(s), max(s, default=1), s))
    return dict(zip(names, best, strict=True))


@dataclass(frozen=True)
class Slicer:
    """shares: for each set of heavy variables (as a sorted tuple) the shares of all variables. heavy: values by variable."""

    policy: Formula
    shares: dict[tuple[str, ...], dict[str, int]]
    heavy: dict[str, tuple]
    seeds: dict[str, int]
    degree: int

    @classmethod
    def of(cls, policy: Formula, sizes: dict[str, float], degree: int, heavy: dict[str, tuple] | None = None) -> Slicer:
        heavy = heavy or {}
        sets = [c for n in range(len(heavy) + 1) for c in itertools.combinations(sorted(heavy), n)]
        shares = {c: optimal_shares(policy, sizes, degree, frozenset(c)) for c in sets}
        return cls(policy, shares, heavy, {v: i for i, v in enumerate(sorted(policy.variables()))}, degree)

    def dumps(self) -> str:
        return json.dumps({"policy": str(self.policy), "shares": [[list(k), v] for k, v in self.shares.items()], "heavy": self.heavy, "seeds": self.seeds, "degree": self.degree})

    @classmethod
    def fixed(cls, policy: Formula, shares: str) -> Slicer:
        """Shares as `x=2,y=1`; variables that aren't named have the share 1."""
        given = {k.strip(): int(n) for k, n in (x.split("=") for x in shares.split(",") if x.strip())}
        names = sorted(policy.variables())
        if unknown := set(given) - set(names):
            raise ValueError(f"no free variables of the policy: {', '.join(sorted(unknown))}")
        own = {v: given.get(v, 1) for v in names}
        return cls(policy, {(): own}, {}, {v: i for i, v in enumerate(names)}, math.prod(own.values()))

    @classmethod
    def loads(cls, text: str) -> Slicer:
        from ..plans.formula import parse

        x = json.loads(text)
        return cls(parse(x["policy"]), {tuple(k): v for k, v in x["shares"]}, {k: tuple(v) for k, v in x["heavy"].items()}, x["seeds"], x["degree"])

    def coordinate(self, var: str, value: Column, share: int) -> Column:
        """Of 0 to share - 1. Plain arithmetic on integers under 2^48, so that SQL elsewhere can repeat it; else on a hash of
        the value's text."""
        text = value.cast("string")
        whole = text.try_cast("bigint")
        number = F.when(F.abs(whole) < 1 << 48, whole).otherwise(F.shiftright(F.xxhash64(text), 16))
        return F.pmod(number * 7919 + self.seeds[var] * 104729, F.lit(share)).cast("int")

    def slices(self, values: dict[str, Column]) -> Column:
        """Array of the slices of an assignment; unbound variables range over all coordinates (and both kinds, if heavy)."""
        found = []
        for chosen, shares in self.shares.items():
            fits = F.lit(True)
            for v in self.heavy:
                if v in values:
                    is_heavy = values[v].cast("string").isin(*map(str, self.heavy[v])) if self.heavy[v] else F.lit(False)
                    fits &= is_heavy if v in chosen else ~is_heavy
            out, stride = F.array(F.lit(0)), 1
            for v, share in shares.items():
                if v in values:
                    step = self.coordinate(v, values[v], share) * stride
                    out = F.transform(out, _plus(step))
                elif share > 1:
                    steps = F.transform(F.sequence(F.lit(0), F.lit(share - 1)), _times(stride))
                    out = F.flatten(F.transform(out, _each(steps)))
                stride *= share
            found.append(F.when(fits, out).otherwise(F.array().cast("array<int>")))
        return F.array_distinct(F.concat(*found))

    def assign(self, facts: DataFrame) -> DataFrame:
        """facts (tp, ts, rel, args) with a row for each slice that needs the fact; facts that no atom matches go."""
        per_atom = []
        for a in self.policy.atoms():
            fits = (F.col("rel") == a.name) & (F.size("args") == len(a.terms))
            values: dict[str, Column] = {}
            for i, t in enumerate(a.terms):
                arg = F.get("args", F.lit(i))
                if isinstance(t, Const):
                    fits &= arg == F.lit(str(t.value))
                elif t.name in values:
                    fits &= arg == values[t.name]
                elif t.name in self.seeds:
                    values[t.name] = arg
            per_atom.append(F.when(fits, self.slices(values)).otherwise(F.array().cast("array<int>")))
        return facts.withColumn("slice", F.explode(F.array_distinct(F.concat(*per_atom))))

    def canonical(self, verdicts: DataFrame) -> DataFrame:
        """Verdicts (slice, variables...) of the one slice that their values belong to."""
        return verdicts.filter(F.col("slice") == self.slices({v: F.col(v) for v in self.policy.variables()})[0])

    def verdicts(self, facts: DataFrame, timepoints: DataFrame, signature: dict[str, tuple[str, ...]], negate: bool = False) -> DataFrame:
        """The policy evaluated in each slice by itself, each verdict taken from the slice that it belongs to.

        Every atom gets the slice as a further argument, so that all joins and windows of the plan are partitioned by it.
        """
        dealt = self.assign(facts).select("tp", "ts", "rel", F.concat("args", F.array(F.col("slice").cast("string"))).alias("args"))
        trace = from_facts(dealt, timepoints, {n: (*kinds, "int") for n, kinds in signature.items()})
        found = monitor(_in_slice(self.policy), trace, negate).withColumnRenamed(_SLICE, "slice")
        names = self.policy.variables()
        return self.canonical(found).select("tp", "ts", *names)

    def describe(self) -> str:
        """A line for each set of heavy variables with the shares of all variables."""
        return "\n".join(f"heavy {{{', '.join(c)}}}: " + ", ".join(f"{v}={n}" for v, n in s.items()) for c, s in self.shares.items())

    def needs_filter(self) -> bool:
        names = [a.name for a in self.policy.atoms()]
        return len(set(names)) < len(names) or bool(self.heavy) or _rigid(self.policy)


#: The argument that holds the slice when a policy is evaluated in each.
_SLICE = "slice_"


def _in_slice(f: Formula) -> Formula:
    if f.kind in ("true", "false"):
        raise PolicyError("TRUE and FALSE have no facts to be sliced by")
    terms = (*f.terms, Var(_SLICE)) if f.kind == "pred" else f.terms
    return replace(f, args=tuple(map(_in_slice, f.args)), terms=terms)


def relevant(policy: Formula, facts: DataFrame) -> DataFrame:
    """The facts that some atom of the policy matches."""
    return Slicer.fixed(policy, "").assign(facts).drop("slice")


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions an integer that repartition(n, key) deals to it."""
    tried = 16 * n
    while True:
        got = spark.range(tried).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("key")).orderBy("p").collect()
        if len(got) == n:
            return [r.key for r in got]
        tried *= 4


def by_slice(sliced: DataFrame, n: int) -> DataFrame:
    """Rows dealt to n partitions so that slice s is in partition s mod n, with no other slice if there are n or less."""
    keys = F.array(*map(F.lit, partition_keys(sliced.sparkSession, n))).cast("array<bigint>")
    return sliced.repartition(n, F.element_at(keys, F.pmod("slice", F.lit(n)).cast("int") + 1))


def _rigid(f: Formula) -> bool:
    return f.kind in ("eq", "less") or any(map(_rigid, f.args))


def _plus(step: Column):
    return lambda x: x + step


def _times(stride: int):
    return lambda x: x * stride


def _each(steps: Column):
    return lambda x: F.transform(steps, lambda y: x + y)


def load(sliced: DataFrame) -> DataFrame:
    """(slice, events)."""
    return sliced.groupBy("slice").agg(F.count("*").alias("events"))


def costs(facts: DataFrame, slicers: dict[str, Slicer]) -> DataFrame:
    """(slicer, cost): the largest load that any slice gets under each slicer."""
    out = None
    for name, s in slicers.items():
        one = load(s.assign(facts)).agg(F.coalesce(F.max("events"), F.lit(0)).alias("cost")).select(F.lit(name).alias("slicer"), "cost")
        out = one if out is None else out.union(one)
    return out


class Decider:
    """Decides, window by window, whether to slice anew: a candidate that stays the same gains stability, another halves it, and the
    cost of adapting is shared among the windows that the candidate is likely to last."""

    def __init__(self, current: Slicer, adapt_cost: float, per_event: float = 1.0) -> None:
        self.current, self.adapt_cost, self.per_event = current, adapt_cost, per_event
        self.candidate: Slicer | None = None
        self.stable = 1.0

    def step(self, candidate: Slicer, cost_old: float, cost_new: float) -> bool:
        self.stable = self.stable + 1 if candidate == self.candidate else max(1.0, self.stable / 2)
        self.candidate = candidate
        adapt = should_adapt(cost_old, cost_new, self.adapt_cost, self.stable, self.per_event)
        if adapt:
            self.current = candidate
        return adapt


def planned_shares(facts: DataFrame, policy: Formula, width: int, degree: int, mode: str = "predictive") -> DataFrame:
    """(start, variable, share): the shares for each window, planned from its own rates (`predictive`), from those of the window
    before it (`reactive`, the first from its own), or from the first window's (`static`).

    The rates, a row for each window and relation, are planned on the driver."""
    spark = facts.sparkSession
    names = {a.name for a in policy.atoms()}
    rates: dict[int, dict[str, float]] = {}
    for r in relation_frequency(facts, width).filter(F.col("rel").isin(*names)).collect():
        rates.setdefault(r["start"], {})[r["rel"]] = float(r["count"])
    starts = sorted(rates)
    source = {"predictive": starts, "reactive": [*starts[:1], *starts[:-1]], "static": starts[:1] * len(starts)}[mode]
    rows = [(a, v, n) for a, b in zip(starts, source, strict=True) for v, n in optimal_shares(policy, {x: rates[b].get(x, 0.0) for x in names}, degree).items()]
    return spark.createDataFrame(rows, "start bigint, variable string, share int")


def planned_lines(lines: DataFrame, plans: DataFrame) -> DataFrame:
    """Lines (ts, line) of a trace with a line >set_slicer x=2,y=1< before each window that has a plan; column first is 0 for
    those and 1 for the trace's, to sort by after ts."""
    shares = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "variable", "share"))), ",")
    commands = plans.groupBy(F.col("start").alias("ts")).agg(F.concat(F.lit(">set_slicer "), shares, F.lit("<")).alias("line"))
    return commands.select("ts", F.lit(0).alias("first"), "line").union(lines.select("ts", F.lit(1), "line"))


def should_adapt(cost_old: float, cost_new: float, adapt_cost: float, stable_windows: float, per_event: float = 1.0) -> bool:
    return cost_new * per_event + adapt_cost / max(stable_windows, 1e-9) < cost_old * per_event
