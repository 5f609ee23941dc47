"""Quality classifier from weak labels.

Heuristic labellers vote good or poor on documents, or abstain. Expectation-maximisation over the counts of vote
patterns (at most 2^labellers, so the driver holds a bounded table that covers all documents) estimates each labeller's
accuracy. The posterior labels of a bounded sample train a linear scorer over hashed word
shapes and statistics, which scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import arrow_slices, checkpointed, slices, small_batches
from .textkit import U, encoded, mix, words
from .textstats import measure

#: name: (vote, when it is cast), over the columns of textstats.measure. Else the labeller abstains.
LABELLERS = {
    "symbols": (-1, lambda s: s.n_symbols > 0.02 * s.word_chars),
    "marked_words": (-1, lambda s: s.n_symbols > 0.15 * s.n_words),
    "repeats": (-1, lambda s: s.n_repeat_words > 0.3 * s.n_words),
    "vocabulary": (-1, lambda s: (s.n_words >= 20) & (s.n_distinct < 0.4 * s.n_words)),
    "capitals": (-1, lambda s: (s.n_words >= 5) & (s.n_capitals > 0.1 * s.n_chars)),
    "stops": (-1, lambda s: (s.n_words >= 5) & (s.n_stops > 0.5 * s.n_words)),
    "lines": (-1, lambda s: (s.n_lines >= 3) & (s.n_dup_lines > 0.4 * s.n_lines)),
    "word_length": (-1, lambda s: (s.n_words >= 5) & ((s.word_chars > 8 * s.n_words) | (s.word_chars < 3 * s.n_words))),
    "empty": (-1, lambda s: s.n_words == 0),
    "varied": (1, lambda s: (s.n_words > 0) & (s.n_distinct > 0.45 * s.n_words) & (s.n_repeat_words <= 0.3 * s.n_words) & (s.n_symbols <= 0.005 * s.word_chars)),
    "prose": (1, lambda s: (s.n_words > 0) & (s.n_stops <= 0.5 * s.n_words) & (s.n_capitals <= 0.1 * s.n_chars) & (s.n_symbols <= 0.005 * s.word_chars) & (s.n_distinct > 0.4 * s.n_words) & (s.n_repeat_words <= 0.3 * s.n_words)),
}
DIMS = 1 << 18
#: Bytes to their shapes: small letters (and all that isn't ASCII), capitals, digits; other characters stay.
SHAPES = bytes(97 if 97 <= c <= 122 or c > 127 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


def votes(stats: pd.DataFrame) -> np.ndarray:
    """-1 poor, 0 abstain, 1 good; a column for each labeller."""
    return np.stack([np.where(cast(stats), vote, 0) for vote, cast in LABELLERS.values()], axis=1).astype(np.int8)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_slices(batches, "text"):
        cast = votes(measure(batch["text"].to_pylist()))
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cast.T), batch["id"]], [*LABELLERS, "id"])


class LabelModel:
    """Each labeller's accuracy, fitted by expectation-maximisation on patterns with counts.

    A vote is right with the labeller's accuracy, whatever the class; abstaining says nothing. Accuracies start from, and are
    smoothed towards, `start`, with the weight of `smooth` of all votes. The share of good texts is given: left free, it
    explains away every labeller that nothing contradicts.
    """

    def __init__(self, rounds: int = 200, start: float = 0.85, smooth: float = 0.02, prior: float = 0.75) -> None:
        self.rounds, self.start, self.smooth, self.prior = rounds, start, smooth, prior

    def fit(self, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        counts = counts.astype(float)
        total = counts.sum()
        self.accuracy = np.full(patterns.shape[1], self.start)
        for _ in range(self.rounds):
            good = self.posterior(patterns)
            right = np.array([((patterns[:, j] > 0) * good * counts + (patterns[:, j] < 0) * (1 - good) * counts).sum() for j in range(patterns.shape[1])])
            cast = ((patterns != 0) * counts[:, None]).sum(axis=0)
            new = (right + self.start * self.smooth * total) / (cast + self.smooth * total)
            done = np.abs(new - self.accuracy).max() < 1e-7
            self.accuracy = np.clip(new, 0.5, 0.999)
            if done:
                break
        return self

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior)) + patterns @ np.log(self.accuracy / (1 - self.accuracy))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def features(texts: list[str | None], s: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, value) of hashed word shapes (as shares of the words) and of statistics in steps."""
    w = words([t.translate(SHAPES) for t in encoded(texts)])
    n = np.diff(w.offsets)
    row = np.repeat(np.arange(len(n)), n)
    key, first, count = np.unique(mix(w.hashes ^ mix(row.astype(np.uint64), 3), 4), return_index=True, return_counts=True)
    r = [row[first]]
    d = [(w.hashes[first] % U(DIMS)).astype(np.int64)]
    v = [np.sqrt(count / np.maximum(1, n[r[0]]))]
    for k, (a, b) in enumerate((("n_symbols", "word_chars"), ("n_repeat_words", "n_words"), ("n_distinct", "n_words"), ("n_capitals", "n_chars"), ("n_stops", "n_words"), ("n_dup_lines", "n_lines"), ("word_chars", "n_words"))):
        step = np.minimum(20 * s[a] / np.maximum(1, s[b]), 400).astype(np.int64).to_numpy()
        r.append(np.arange(len(n)))
        d.append((mix((step + 1000 * (k + 1)).astype(np.uint64), 21) % U(DIMS)).astype(np.int64))
        v.append(np.ones(len(n)))
    return np.concatenate(r), np.concatenate(d), np.concatenate(v)


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in slices(batches, "text"):
        texts = frame["text"].to_list()
        r, d, v = features(texts, measure(texts))
        order = np.argsort(r, kind="stable")
        at = np.searchsorted(r[order], np.arange(len(frame) + 1))
        yield pd.DataFrame({"y": frame["y"].to_numpy(), "dims": [d[order][a:b] for a, b in zip(at[:-1], at[1:], strict=True)], "values": [v[order][a:b] for a, b in zip(at[:-1], at[1:], strict=True)]})


def train_linear(rows: np.ndarray, dims: np.ndarray, values: np.ndarray, y: np.ndarray, size: int = DIMS, rounds: int = 150, rate: float = 0.3, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adam."""
    used, local = np.unique(dims, return_inverse=True)
    w, b = np.zeros(len(used)), 0.0
    m, s = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, values * w[local], len(y)) + b, -30, 30)))
        e = (p - y) / len(y)
        g = np.append(np.bincount(local, values * e[rows], len(used)) + ridge * w, e.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    out = np.zeros(size, np.float32)
    out[used] = w
    return out, float(b)


def weak_quality(docs: DataFrame, sample: int = 8_000, keep: float = 0.5) -> DataFrame:
    """Rows (doc_id, posterior, score, kept) for every row of `docs`.

    posterior is the label model's belief that the text is good, score the linear scorer's; both lie between 0 and 1, and
    kept is score >= `keep`. All documents count for the label model; the scorer is fitted to the posteriors of at most
    `sample` documents, those with the least hashes of their ids. Null texts count as empty; extra columns of `docs`
    aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = list(LABELLERS)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    stats = checkpointed(rows.mapInArrow(_voted, ", ".join(f"{n} tinyint" for n in names) + ", id bigint"))
    seen = stats.groupBy(*names).agg(F.count("*").alias("n")).toPandas()
    if seen.empty:
        return stats.select(F.col("id").alias("doc_id"), F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    patterns = seen[names].to_numpy()
    model = LabelModel().fit(patterns, seen["n"].to_numpy())

    table = spark.createDataFrame([(*map(int, p), float(q)) for p, q in zip(patterns, model.posterior(patterns), strict=True)], ", ".join(f"{n} tinyint" for n in names) + ", posterior double")
    picked = stats.join(F.broadcast(table), names).select("id", F.col("posterior").alias("y")).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(sample)
    # one text for an id that repeats, so that no id brings more rows than one
    sampled = rows.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    got = sampled.mapInPandas(_featured, "y double, dims array<bigint>, values array<double>").toPandas()
    if len(got):
        owner = np.repeat(np.arange(len(got)), got["dims"].str.len())
        w, b = train_linear(owner, np.concatenate(got["dims"].to_list()), np.concatenate(got["values"].to_list()), got["y"].to_numpy())
    else:
        w, b = np.zeros(DIMS, np.float32), 0.0
    shared = spark.sparkContext.broadcast((w, b, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, model = shared.value
        for batch in arrow_slices(batches, "text"):
            texts = batch["text"].to_pylist()
            measured = measure(texts)
            r, d, v = features(texts, measured)
            score = 1 / (1 + np.exp(-np.clip(np.bincount(r, v * w[d], len(texts)) + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(model.posterior(votes(measured))), pa.array(score), pa.array(score >= keep)], ["doc_id", "posterior", "score", "kept"])

    return rows.mapInArrow(run, "doc_id bigint, posterior double, score double, kept boolean")
