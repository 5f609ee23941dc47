"""Policies as SQL straight from the definitions (EXISTS and NOT EXISTS over time-points), to compare plans with."""

from __future__ import annotations

from .compile import _guardable
from .formula import INF, TRUE, Const, Formula, neg, normalised, parse

EVENTS = (
    "SELECT event_id AS tp, epoch_us(ts) // 1000000 AS ts FROM events",
    lambda name: f"SELECT event_id AS tp, epoch_us(ts) // 1000000 AS ts, user_id AS x0, event_id AS x1 FROM events WHERE event_type = '{name}'",
)
_DAYS = "SELECT row_number() OVER (ORDER BY ts) - 1 AS tp, ts FROM (SELECT DISTINCT epoch_us(o_orderdate) // 1000000 AS ts FROM orders)"
ORDERS = (_DAYS, lambda name: f"SELECT tp, ts, o_custkey AS x0, o_orderkey AS x1 FROM orders JOIN t ON t.ts = epoch_us(o_orderdate) // 1000000 WHERE o_orderstatus = '{name.removeprefix('ord_')}'")


class Definition:
    def __init__(self, source) -> None:
        self.source = source
        self.parts = [f"t AS ({source[0]})"]

    def add(self, sql: str) -> str:
        name = f"c{len(self.parts)}"
        self.parts.append(f"{name} AS ({sql})")
        return name

    def sat(self, f: Formula) -> tuple[str, tuple[str, ...]]:
        v = f.variables()
        if f.kind == "pred":
            where, seen, out = [], {}, []
            for i, t in enumerate(f.terms):
                if isinstance(t, Const):
                    where.append(f"x{i} = " + (str(t.value) if isinstance(t.value, int) else f"'{t.value}'"))
                elif t.name in seen:
                    where.append(f"x{i} = x{seen[t.name]}")
                else:
                    seen[t.name] = i
                    out.append(f"x{i} AS v_{t.name}")
            return self.add(f"SELECT DISTINCT {', '.join(['tp', 'ts', *out])} FROM ({self.source[1](f.name)})" + (f" WHERE {' AND '.join(where)}" if where else "")), v
        if f.kind in ("true", "false"):
            return self.add(f"SELECT tp, ts FROM t WHERE {f.kind}"), v
        if f.kind == "exists":
            a, w = self.sat(f.args[0])
            keep = [x for x in w if x != f.name]
            return self.add("SELECT DISTINCT " + ", ".join(["tp", "ts", *(f"v_{x}" for x in keep)]) + f" FROM {a}"), tuple(keep)
        if f.kind in ("previous", "next"):
            a, w = self.sat(f.args[0])
            d = 1 if f.kind == "previous" else -1
            return self.add("SELECT " + ", ".join(["t.tp", "t.ts", *(f"a.v_{x}" for x in w)]) + f" FROM t JOIN {a} a ON a.tp = t.tp - {d} WHERE {self.gap(f, f'(t.ts - a.ts) * {d}')}"), w
        if f.kind == "or":
            (a, w), (b, _) = map(self.sat, f.args)
            cols = ", ".join(["tp", "ts", *(f"v_{x}" for x in w)])
            return self.add(f"SELECT {cols} FROM {a} UNION SELECT {cols} FROM {b}"), w
        if f.kind == "not" and not f.variables():
            a, _ = self.sat(f.args[0])
            return self.add(f"SELECT tp, ts FROM t WHERE NOT EXISTS (SELECT 1 FROM {a} a WHERE a.tp = t.tp)"), ()
        parts = [p for p in self.flat(f) if p != TRUE]
        order = {"pred": 0, "exists": 0, "previous": 0, "next": 0, "or": 1, "eq": 2, "less": 4, "not": 5, "historically": 5, "always": 5, "trigger": 5, "release": 5}
        parts.sort(key=lambda p: (order.get(p.kind, 3), -len(p.variables())))
        g, w = (self.sat(parts.pop(0))) if order.get(parts[0].kind, 3) < 2 else ("t", ())
        for p in parts:
            g, w = self.join(g, w, p)
        return g, w

    def flat(self, f: Formula) -> list[Formula]:
        return [x for a in f.args for x in self.flat(a)] if f.kind == "and" else [f]

    def gap(self, f: Formula, gap: str) -> str:
        return f"{gap} >= {f.interval.low}" + (f" AND {gap} < {f.interval.high}" if f.interval.high is not INF else "")

    def term(self, t) -> str:
        return (str(t.value) if isinstance(t.value, int) else f"'{t.value}'") if isinstance(t, Const) else f"g.v_{t.name}"

    def join(self, g: str, w: tuple[str, ...], p: Formula) -> tuple[str, tuple[str, ...]]:
        own = ", ".join(["g.tp", "g.ts", *(f"g.v_{x}" for x in w)])
        inner = p.args[0] if p.kind == "not" else p
        word = "NOT " if p.kind == "not" else ""
        if inner.kind in ("eq", "less"):
            free = [t for t in inner.terms if not isinstance(t, Const) and t.name not in w]
            if free:
                other = next(t for t in inner.terms if t is not free[0])
                return self.add(f"SELECT {own}, {self.term(other)} AS v_{free[0].name} FROM {g} g"), (*w, free[0].name)
            sign = "=" if inner.kind == "eq" else "<"
            return self.add(f"SELECT {own} FROM {g} g WHERE {word}({self.term(inner.terms[0])} {sign} {self.term(inner.terms[1])})"), w
        if p.kind in ("historically", "always"):
            past = p.kind == "historically"
            body = p.args[0]
            hold = self.sat(neg(body))[0] if body.kind == "not" else self.sat(body)[0]
            same = "".join(f" AND a.v_{x} = g.v_{x}" for x in body.variables())
            bad = f"{'' if body.kind == 'not' else 'NOT '}EXISTS (SELECT 1 FROM {hold} a WHERE a.tp = k.tp{same})"
            when = f"k.tp {'<=' if past else '>='} g.tp AND {self.gap(p, 'g.ts - k.ts' if past else 'k.ts - g.ts')}"
            return self.add(f"SELECT {own} FROM {g} g WHERE NOT EXISTS (SELECT 1 FROM t k WHERE {when} AND {bad})"), w
        if p.kind in ("trigger", "release"):
            return self.join(g, w, Formula("not", (Formula("since" if p.kind == "trigger" else "until", tuple(map(neg, p.args)), interval=p.interval),)))
        if inner.kind in ("once", "eventually", "since", "until"):
            past = inner.kind in ("once", "since")
            q, v = self.sat(inner.args[-1])
            on = f"q.tp {'<=' if past else '>='} g.tp AND {self.gap(inner, 'g.ts - q.ts' if past else 'q.ts - g.ts')}" + "".join(f" AND q.v_{x} = g.v_{x}" for x in v if x in w)
            if inner.kind in ("since", "until"):
                left = inner.args[0]
                a, u = self.sat(neg(left) if left.kind == "not" else left)
                span = "k.tp > q.tp AND k.tp <= g.tp" if past else "k.tp >= g.tp AND k.tp < q.tp"
                same = "".join(f" AND k.v_{x} = q.v_{x}" for x in u)
                on += f" AND NOT EXISTS (SELECT 1 FROM {a} k WHERE {span}{same})" if left.kind == "not" else f" AND (SELECT count(*) FROM {a} k WHERE {span}{same}) = abs(g.tp - q.tp)"
            if p.kind == "not" or set(v) <= set(w):
                pairs = self.add(f"SELECT DISTINCT {own} FROM {g} g, {q} q WHERE {on}")
                if p.kind != "not":
                    return pairs, w
                same = "".join(f" AND a.v_{x} = g.v_{x}" for x in w)
                return self.add(f"SELECT {own} FROM {g} g WHERE NOT EXISTS (SELECT 1 FROM {pairs} a WHERE a.tp = g.tp{same})"), w
            more = [x for x in v if x not in w]
            return self.add(f"SELECT DISTINCT {own}, " + ", ".join(f"q.v_{x}" for x in more) + f" FROM {g} g, {q} q WHERE {on}"), (*w, *more)
        if p.kind == "or":
            sides = []
            for a in p.args:
                x, y = g, w
                for part in self.flat(a):
                    x, y = self.join(x, y, part)
                sides.append((x, y))
            cols = ", ".join(["tp", "ts", *(f"v_{x}" for x in sides[0][1])])
            return self.add(f"SELECT {cols} FROM {sides[0][0]} UNION SELECT {cols} FROM {sides[1][0]}"), sides[0][1]
        a, v = self.sat(inner)
        same = "a.tp = g.tp" + "".join(f" AND a.v_{x} = g.v_{x}" for x in v if x in w)
        if p.kind == "not":
            return self.add(f"SELECT {own} FROM {g} g WHERE NOT EXISTS (SELECT 1 FROM {a} a WHERE {same})"), w
        more = [x for x in v if x not in w]
        return self.add("SELECT DISTINCT " + own + "".join(f", a.v_{x}" for x in more) + f" FROM {g} g JOIN {a} a ON {same}"), (*w, *more)


def definition_sql(policy: str, source=EVENTS, negate: bool = False) -> str:
    f = parse(policy)
    d = Definition(source)
    name, _ = d.sat(_guardable(normalised(f, negate)))
    return "WITH " + ",\n".join(d.parts) + "\nSELECT " + ", ".join(["tp", "ts", *(f"v_{v} AS {v}" for v in f.variables())]) + f" FROM {name}"
