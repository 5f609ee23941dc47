"""Synthetic traces, generated in parallel and the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Which argument of each relation holds which variable.
SHAPES = {"star": (("w", "x"), ("w", "y"), ("w", "z")), "linear": (("w", "x"), ("x", "y"), ("y", "z")), "triangle": (("x", "y"), ("y", "z"), ("z", "x"))}


def pattern_trace(spark: SparkSession, shape: str, seconds: int, rate: int, index_rate: int = 1, violations: float = 0.01, window: int = 10, seed: int = 1, zipf: dict[str, float] | None = None) -> DataFrame:
    """Facts (tp, ts, rel, args): `rate` facts a second in `index_rate` time-points, of relations A, B and C.

    A third of the facts are an A; each is followed within `window` seconds by a B with the shared values, and a share of
    `violations` by a C as well; the rest of the C have values of their own. Variables are uniform, or in `zipf` follow Zipf's
    law with that exponent (over 1), C's values then shifted by 1,000,000 so that heavy ones don't meet by chance."""
    zipf = zipf or {}
    draw = lambda v, i: F.least(F.floor(F.pow(1 - F.rand(seed + i), F.lit(-1 / (zipf[v] - 1)))), F.lit(999_999_999)) if v in zipf else F.floor(F.rand(seed + i) * 1_000_000_000)
    n = seconds * rate // 3
    base = spark.range(n).select("id", (F.rand(seed) * seconds).alias("at"), *[draw(v, i).alias(v) for i, v in enumerate("wxyz", 1)], (F.rand(seed + 9) * window).alias("later"), (F.rand(seed + 10) < violations).alias("bad"))
    rows = []
    for k, (rel, args) in enumerate(zip("ABC", SHAPES[shape], strict=True)):
        values = [F.col(v) if rel != "C" else F.when(F.col("bad"), F.col(v)).otherwise(F.col(v) + (1_000_000 if v in zipf else 1_000_000_000)) for v in args]
        rows.append(base.select((F.col("at") + F.col("later") * k / 2).alias("at"), F.lit(rel).alias("rel"), F.array(*[v.cast("string") for v in values]).alias("args")))
    out = rows[0].union(rows[1]).union(rows[2])
    return out.select(F.floor(F.col("at") * index_rate).cast("bigint").alias("tp"), F.floor("at").cast("bigint").alias("ts"), "rel", "args")


def policy_text(shape: str, window: int = 10) -> str:
    """The policy that the generated violations break."""
    a, b, c = (f"{r}({','.join(v)})" for r, v in zip("ABC", SHAPES[shape], strict=True))
    return f"(ONCE [0,{window}) {a}) IMPLIES {b} IMPLIES ALWAYS [0,{window}) NOT {c}"


def partitioned(facts: DataFrame, weights: tuple[float, ...], seed: int = 1) -> DataFrame:
    """`facts` with column part: one of the inputs, drawn by weight."""
    total, u, out = sum(weights), F.rand(seed), F.lit(len(weights) - 1)
    at = total
    for i in range(len(weights) - 1, 0, -1):
        at -= weights[i]
        out = F.when(u < at / total, i - 1).otherwise(out)
    return facts.withColumn("part", out)


def delayed(facts: DataFrame, sigma: float, most: float, seed: int = 1) -> DataFrame:
    """`facts` with column emission: ts plus the size of a normal delay that is drawn anew while it exceeds `most` seconds (eight
    times, then evenly)."""
    draws = F.array(*[F.abs(F.randn(seed + i) * sigma) for i in range(8)], F.rand(seed + 8) * most)
    return facts.withColumn("emission", F.col("ts") + F.filter(draws, lambda d: d <= most)[0])


def watermarks(delayed: DataFrame, period: int) -> DataFrame:
    """(part, emission, ts): at the end of each period of an input, one second before the least time-stamp that is still to come
    from it; none after its last."""
    per = delayed.groupBy("part", F.floor(F.col("emission") / period).alias("p")).agg(F.min("ts").alias("least"))
    later = Window.partitionBy("part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("ts", F.min("least").over(later) - 1).filter("ts IS NOT NULL").select("part", ((F.col("p") + 1) * period).cast("double").alias("emission"), "ts")


def start_lines(parts: DataFrame) -> DataFrame:
    """(part, line): the header >START ts< of each input, with its first time-stamp."""
    return parts.groupBy("part").agg(F.concat(F.lit(">START "), F.min("ts"), F.lit("<")).alias("line"))


def signature_trace(spark: SparkSession, signature: dict[str, tuple[str, ...]], seconds: int, rate: int, index_rate: int = 1, fresh: float = 0.1, recent: int = 100, seed: int = 1) -> DataFrame:
    """Facts (tp, ts, rel, args) of the signature's relations in equal shares. A share `fresh` of the values is new, the others are
    those of one of the last `recent` facts."""
    names = sorted(signature)
    kind = F.floor(F.rand(seed) * len(names)).cast("int")
    rows = spark.range(seconds * rate).select("id", kind.alias("kind"))
    value = lambda i: F.pmod(F.xxhash64(F.lit(i), F.when(F.rand(seed + 2 * i + 1) < fresh, F.col("id")).otherwise(F.col("id") - 1 - F.floor(F.rand(seed + 2 * i + 2) * recent))), F.lit(1_000_000_000)).cast("string")
    most = max(map(len, signature.values()), default=0)
    size = F.element_at(F.array(*[F.lit(len(signature[n])) for n in names]), F.col("kind") + 1)
    args = F.slice(F.array(*[value(i) for i in range(most)]), F.lit(1), size) if most else F.array().cast("array<string>")
    rel = F.element_at(F.array(*map(F.lit, names)), F.col("kind") + 1)
    return rows.select(F.floor(F.col("id") * index_rate / rate).cast("bigint").alias("tp"), F.floor(F.col("id") / rate).cast("bigint").alias("ts"), rel.alias("rel"), args.alias("args"))
