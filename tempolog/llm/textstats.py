"""Statistics of whole texts, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import arrow_slices, small_batches
from .textkit import U, encoded, grams, mix, words

#: Fixed values of the contract: characters counted as symbols, words in a window.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\r\x0b\x0c"
WINDOW = 8

SCHEMA = "id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_chars bigint, n_lines bigint, n_digits bigint, n_capitals bigint, n_stops bigint, n_distinct bigint"


def repeated_words(w, window: int = WINDOW) -> np.ndarray:
    """Per document, the words inside windows of `window` words that occur twice or more in it."""
    n = np.diff(w.offsets)
    h, at = grams(w, window)
    if not len(h):
        return np.zeros(len(n), np.int64)
    doc = np.repeat(np.arange(len(n)), np.diff(at))
    _, back, count = np.unique(mix(h ^ mix(doc.astype(np.uint64), 3), 4), return_inverse=True, return_counts=True)
    start = w.offsets[doc] + np.arange(len(h)) - at[doc]
    twice = start[count[back] > 1]
    cover = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, np.minimum(twice + window, len(w.hashes)), -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return hit[w.offsets[1:]] - hit[w.offsets[:-1]]


def distinct_words(w) -> np.ndarray:
    doc = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
    _, first = np.unique(mix(w.hashes ^ mix(doc.astype(U), 3), 4), return_index=True)
    return np.bincount(doc[first], minlength=len(w.offsets) - 1)


def duplicate_lines(text: str) -> int:
    """Lines that have a word and equal an earlier line."""
    seen: set[str] = set()
    found = 0
    for line in text.split("\n"):
        if line in seen:
            found += 1
        elif line.strip(WHITE):
            seen.add(line)
    return found


def measure(texts: list[str | None]) -> pd.DataFrame:
    texts = [t or "" for t in texts]
    w = words(encoded(texts))
    return pd.DataFrame({
        "n_words": np.diff(w.offsets),
        "word_chars": [len(t) - sum(map(t.count, WHITE)) for t in texts],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [duplicate_lines(t) for t in texts],
        "n_repeat_words": repeated_words(w),
        "n_chars": [len(t) for t in texts],
        "n_lines": [t.count("\n") + bool(t) for t in texts],
        "n_digits": [sum(map(t.count, "0123456789")) for t in texts],
        "n_capitals": [sum(map(t.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for t in texts],
        "n_stops": [sum(map(t.count, ".!?")) for t in texts],
        "n_distinct": distinct_words(w),
    })


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_slices(batches, "text"):
        got = measure(batch["text"].to_pylist())
        yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(got[c], pa.int64()) for c in got)], ["id", *got])


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of statistics (id and SCHEMA's counts) for each row of `docs`; a null text counts as empty.

    Nothing but the two named columns is read. Texts are measured whole, in frames of bounded size.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_run, SCHEMA)
