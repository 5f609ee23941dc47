"""Quality rules as a learned decision list.

Sequential covering: rules that recognise poor texts are learned one after another from labelled statistics. A rule is a
conjunction of thresholds, grown on two thirds of the rows by the gain in information and pruned on the others; the rows
that it covers leave, and learning ends when a rule isn't precise enough. The list becomes one ordered Spark expression.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import text_stats

#: Statistics that rules test, as SQL over the columns of text_stats.
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(n_chars, 1)",
    "capital_share": "n_capitals / greatest(n_chars, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "n_words": "CAST(n_words AS DOUBLE)",
}


class Test(NamedTuple):
    feature: str
    at_least: bool
    value: float


class Rule(NamedTuple):
    tests: tuple[Test, ...]
    covered: int
    poor: int


def _hits(x: np.ndarray, names: list[str], tests) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in tests:
        col = x[:, names.index(t.feature)]
        out &= col >= t.value if t.at_least else col <= t.value
    return out


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], limit: int) -> list[Test]:
    tests: list[Test] = []
    inside = np.ones(len(y), bool)
    while len(tests) < limit and y[inside].mean() < 1:
        p0 = y[inside].sum()
        base, best = math.log2(p0 / inside.sum()), (1e-9, None)
        for j, name in enumerate(names):
            col = x[inside, j]
            order = np.argsort(col, kind="stable")
            v, poor = col[order], np.cumsum(y[inside][order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut) > 256:
                cut = cut[np.linspace(0, len(cut) - 1, 256).astype(int)]
            for at_least in (False, True):
                p = p0 - poor[cut] if at_least else poor[cut]
                n = len(v) - 1 - cut if at_least else cut + 1
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / n) - base), -1)
                if len(gain) and gain.max() > best[0]:
                    c = cut[gain.argmax()]
                    best = (gain.max(), Test(name, at_least, float((v[c] + v[c + 1]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= _hits(x, names, tests[-1:])
    return tests


def learn_list(x: np.ndarray, y: np.ndarray, names: list[str], most_rules: int = 12, most_tests: int = 3, precision: float = 0.9, least_cover: int = 3) -> list[Rule]:
    """Ordered rules for y = 1 (poor). The same rows give the same rules, whatever their order."""
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    rules: list[Rule] = []
    turn = np.arange(len(y))
    while len(rules) < most_rules and y.sum() >= least_cover:
        grown = turn[: len(y)] % 3 != 2
        if not y[grown].any():
            break
        tests = _grow(x[grown], y[grown], names, most_tests)
        if not tests:
            break

        def worth(k: int, tests=tests, held=~grown) -> float:
            hit = _hits(x[held], names, tests[:k])
            return (2 * y[held][hit].sum() - hit.sum()) / max(1, hit.sum())

        keep = max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))
        hit = _hits(x, names, tests[:keep])
        if hit.sum() < least_cover or y[hit].mean() < precision:
            break
        rules.append(Rule(tuple(tests[:keep]), int(hit.sum()), int(y[hit].sum())))
        x, y = x[~hit], y[~hit]
    return rules


def as_expression(rules: list[Rule]) -> Column:
    """1-based number of the first rule that fires, 0 if none does."""
    if not rules:
        return F.lit(0)
    out = None
    for i, r in enumerate(rules, 1):
        fires = F.lit(True)
        for t in r.tests:
            fires &= (F.expr(FEATURES[t.feature]) >= t.value) if t.at_least else (F.expr(FEATURES[t.feature]) <= t.value)
        out = (F if out is None else out).when(fires, i)
    return out.otherwise(0)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most `rows` labelled documents, those with the least hashes of their ids: id, text and label.

    Labels that are null or repeat an id with other values are left out; of texts that repeat an id the least counts.
    """
    clear = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("z")).filter("y = z")
    picked = clear.select("id", F.col("y").cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    # at most `rows` short rows, so their size is bounded whatever the input's
    rows = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "id")
    return rows.groupBy("id", "y").agg(F.min("text").alias("text"))


def learn_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 20_000, **options) -> list[Rule]:
    """Rules from at most `rows` labelled documents. Without two classes of labels there are none."""
    picked = labelled_rows(docs, labels, label, rows)
    stats = text_stats(picked, "id").join(picked.select("id", "y").distinct(), "id")
    got = stats.select(F.col("y"), *[F.expr(sql).alias(name) for name, sql in FEATURES.items()]).toPandas()
    if got["y"].nunique() < 2:
        return []
    return learn_list(got[list(FEATURES)].to_numpy(float), (got["y"] == 0).to_numpy(int), list(FEATURES), **options)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """text_stats of `docs` with column rule: the number of the rule that rejects the row, 0 if none does.

    Empty and null texts have zero counts and are judged by them; extra columns of `docs` aren't read.
    """
    return text_stats(docs).withColumn("rule", as_expression(rules))
