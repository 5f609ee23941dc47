"""Toxicity: a counterfactual-regularised linear classifier over hashed words.

Features are the presence of words and of word beginnings (ASCII letters lower-cased; white space and ASCII punctuation
separate words), hashed. A bounded sample of labelled rows chooses the most telling ones and fits their weights by logistic
regression. For sentences that name a group, the same sentence with the terms swapped is scored
too, and the loss adds the squared difference of the two scores, so that a neutral mention carries no weight of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import arrow_slices, schema_with, slices, small_batches, with_columns
from .textkit import PUNCT, U, encoded, mix, words

DIMS = 1 << 18
PREFIXES = (4, 5)
#: Terms that name groups, in sets within which any may stand for another.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"), ("girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("immigrants", "refugees", "natives", "citizens"), ("immigrant", "refugee", "native", "citizen"),
    ("old", "young"), ("disabled", "able-bodied"), ("deaf", "blind"),
)
_SWAP = {a: tuple(b for b in group if b != a) for group in IDENTITIES for a in group}
_TERM = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(sorted(_SWAP, key=len, reverse=True)) + r")(?![A-Za-z0-9])", re.I | re.A)
_SENTENCE = re.compile(r"[^.!?\n]+")


class Model(NamedTuple):
    weights: np.ndarray  # DIMS, zero but for the chosen features
    bias: float


def swapped(sentence: str, turn: int = 0) -> str | None:
    """The sentence with every group term replaced by another of its set; None if it has none."""
    out, n = _TERM.subn(lambda m: (o := _SWAP[m[0].lower()])[turn % len(o)], sentence)
    return out if n else None


def present(texts, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once. chosen: only features where it isn't 0."""
    w = words(encoded(texts), lower=True, delimiters=PUNCT, prefixes=PREFIXES)
    row = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
    found = []
    for k, h in enumerate((w.hashes, *w.prefixes)):
        f = (mix(h, 40 + k) % U(DIMS)).astype(np.int64)
        r = row
        if chosen is not None:
            hit = chosen[f] != 0
            f, r = f[hit], r[hit]
        found.append(r * DIMS + f)
    pair = np.unique(np.concatenate(found))
    return pair // DIMS, pair % DIMS


def score(model: Model, texts) -> np.ndarray:
    r, f = present(texts, model.weights)
    return 1 / (1 + np.exp(-np.clip(np.bincount(r, model.weights[f], len(texts)) + model.bias, -30, 30)))


def fit(scale: np.ndarray, rows: np.ndarray, feats: np.ndarray, y: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray, int] | None = None, penalty: float = 1.0, ridge: float = 2e-5, rounds: int = 400, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Weights of the features and the bias. scale: how readily each feature's weight grows (the ridge holds weight / scale).
    pairs: (pair, feature, +1 or -1, number of pairs), the differences between sentences and their counterfactuals, whose
    squared scores are penalised."""
    n = len(scale)
    v, b = np.zeros(n), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, s = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        w = scale * v
        e = (1 / (1 + np.exp(-np.clip(np.bincount(rows, w[feats], len(y)) + b, -30, 30))) - y) / len(y)
        g = np.append(scale * np.bincount(feats, e[rows], n) + ridge * v, e.sum())
        if pairs and pairs[3]:
            pair, feat, sign, count = pairs
            gap = np.bincount(pair, sign * w[feat], count)
            g[:-1] += 2 * penalty / count * scale * np.bincount(feat, sign * gap[pair], n)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        v, b = v - move[:-1], b - move[-1]
    return scale * v, float(b)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((2, DIMS), np.int64)
    for frame in slices(batches, "text"):
        r, f = present(frame["text"])
        y = frame["y"].to_numpy()[r]
        for c in (0, 1):
            total[c] += np.bincount(f[y == c], minlength=DIMS)
    at = np.flatnonzero(total.sum(axis=0))
    yield pd.DataFrame({"feature": at, "clean": total[0, at], "toxic": total[1, at]})


def _sampled(chosen: np.ndarray):
    """A row's chosen features, and its (sentence, feature, sign) differences, as 32-bit integers in bytes: the driver collects them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(batches, "text"):
            r, f = present(frame["text"], chosen)
            at = np.searchsorted(r, np.arange(len(frame) + 1))
            gaps = []
            for t, h in zip(frame["text"], frame["id"], strict=True):
                own: list[tuple[int, int, int]] = []
                for i, x in enumerate(_SENTENCE.findall(t or "")):
                    other = swapped(x, int(h) + i)
                    if other is not None:
                        one, two = (set(present([z], chosen)[1].tolist()) for z in (x, other))
                        own += [(i, k, 1) for k in sorted(one - two)] + [(i, k, -1) for k in sorted(two - one)]
                gaps.append(np.array(own, np.int32).tobytes())
            yield pd.DataFrame({"id": frame["id"], "y": frame["y"], "feats": [f[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], "gaps": gaps})

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", features: int = 4096, sample: int = 20_000, penalty: float = 1.0) -> Model:
    """A model from the labelled rows of `docs` (columns id_col and text; labels: id_col and toxic).

    Labels that are null, or repeat an id with other values, are left out, as are null ids; of texts that repeat an id the
    least counts. At most
    `sample` labelled rows, those with the least hashes of their ids, choose the `features` most telling features (3.5
    standard errors at least) and fit the weights.
    With labels of one class only or none, every text gets the same score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    clear = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min("toxic").alias("y"), F.max("toxic").alias("z")).filter("y = z").select("id", F.col("y").cast("int").alias("y"))
    text = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    # at most `sample` short rows, so their size is bounded whatever the input's
    picked = clear.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    toxic, clean = int((picked["y"] == 1).sum()), int((picked["y"] == 0).sum())
    if not toxic or not clean:
        return Model(np.zeros(DIMS, np.float32), 20.0 if toxic and not clean else -20.0 if clean else 0.0)
    wanted = F.broadcast(spark.createDataFrame(picked, "id bigint, y int"))
    # one text for an id that repeats, so that no id brings more rows than one
    rows = text.join(wanted, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    counts = rows.mapInPandas(_counted, "feature bigint, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # how far the feature's share among toxic rows lies from its share among clean ones, in standard errors
    share = (F.col("toxic") + F.col("clean")) / (toxic + clean)
    gap = F.abs(F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean) + 1e-9)
    best = counts.filter("toxic + clean >= 3").select("feature", gap.alias("gap")).filter("gap >= 3.5").orderBy(F.desc("gap"), "feature").limit(features).toPandas()
    chosen = np.zeros(DIMS, bool)
    chosen[best["feature"].to_numpy(np.int64)] = True
    got = rows.mapInPandas(_sampled(chosen), "id bigint, y int, feats binary, gaps binary").toPandas().sort_values("id", kind="stable").reset_index(drop=True)
    at = np.flatnonzero(chosen)
    strength = np.zeros(DIMS)
    strength[best["feature"].to_numpy(np.int64)] = best["gap"].to_numpy(float)
    scale = strength[at] / max(1e-9, strength.max())
    local = np.zeros(DIMS, np.int64)
    local[at] = np.arange(len(at))
    feats = np.frombuffer(b"".join(got["feats"]), np.int32)
    r = np.repeat(np.arange(len(got)), got["feats"].map(len) // 4)
    own = np.repeat(np.arange(len(got)), got["gaps"].map(len) // 12)
    gaps = np.frombuffer(b"".join(got["gaps"]), np.int32).reshape(-1, 3)
    names, pair = np.unique(np.stack([own, gaps[:, 0]]), axis=1, return_inverse=True) if len(gaps) else (np.zeros((2, 0)), np.zeros(0, np.int64))
    w, b = fit(scale, r, local[feats], got["y"].to_numpy(float), (pair.ravel(), local[gaps[:, 1]], gaps[:, 2].astype(float), names.shape[1]), penalty)
    weights = np.zeros(DIMS, np.float32)
    weights[at] = w
    return Model(weights, b)


def scored(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id") -> DataFrame:
    """`docs` with columns score (0 to 1) and predicted (1 if the score is `threshold` or more, else 0).

    Null and empty texts get the score of a text without features. Columns of those names are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text"):
            s = score(shared.value, batch["text"].to_pylist())
            yield with_columns(batch, score=pa.array(s), predicted=pa.array((s >= threshold).astype(np.int32)))

    return keep.mapInArrow(run, schema_with(keep, "score double, predicted int"))
