"""Vectorised word hashing over batches of texts.

Words are maximal runs of bytes outside a delimiter set, which is the same as runs of code points outside it, because
every delimiter is ASCII. Hashes are 64-bit and depend on the bytes only, so that every task and every run agrees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

U = np.uint64
SPACES = b" \t\n\r\x0b\x0c"
SPACE = np.zeros(256, bool)
SPACE[list(SPACES)] = True
#: Everything in ASCII but letters and digits, for word lists that ignore punctuation.
PUNCT = np.zeros(256, bool)
PUNCT[:128] = True
PUNCT[[c for c in range(128) if chr(c).isalnum()]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text hashed at once; longer texts are cut at white space and put together again.
BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit scrambler (the splitmix64 finaliser)."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(NamedTuple):
    hashes: np.ndarray  # of all words, document by document
    offsets: np.ndarray  # document i has hashes[offsets[i]:offsets[i + 1]]
    prefixes: tuple[np.ndarray, ...]  # hashes of the first n bytes, for each n asked for


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def _pieces(texts: Sequence[bytes]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Blocks of (pieces, their documents); a piece ends at white space or at the end of its text."""
    block: list[bytes] = []
    docs: list[int] = []
    room = BLOCK
    for i, t in enumerate(texts):
        at = 0
        while at < len(t) or not t:
            end = len(t)
            if end - at > BLOCK:
                end = at + BLOCK
                while end < len(t) and t[end] not in SPACES:
                    end += 1
            if block and end - at > room:
                yield block, docs
                block, docs, room = [], [], BLOCK
            block.append(t[at:end] if at or end < len(t) else t)
            docs.append(i)
            room -= end - at
            at = end
            if not t:
                break
    if block:
        yield block, docs


def words(texts: Sequence[bytes], lower: bool = False, delimiters: np.ndarray = SPACE, prefixes: Sequence[int] = ()) -> Words:
    counts = np.zeros(len(texts), np.int64)
    parts: list[list[np.ndarray]] = [[] for _ in range(1 + len(prefixes))]
    for block, docs in _pieces(texts):
        data = np.frombuffer(b"\n".join(block) + b"\n", np.uint8)
        gap = delimiters[data]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        starts, ends = edge[0::2], edge[1::2]
        if not len(starts):
            continue
        power, inverse = _grown(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[LOWER[data] if lower else data] * power[: len(data)], out=total[1:])
        first = total[starts]
        undo = inverse[starts]
        parts[0].append(mix((total[ends] - first) * undo))
        for k, n in enumerate(prefixes):
            parts[1 + k].append(mix((total[np.minimum(ends, starts + n)] - first) * undo))
        bounds = np.cumsum([len(b) + 1 for b in block])
        at = np.searchsorted(starts, bounds)
        np.add.at(counts, docs, np.diff(at, prepend=0))
    flat = [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts]
    return Words(flat[0], np.concatenate([[0], np.cumsum(counts)]), tuple(flat[1:]))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and offsets. A document with 1 to k - 1 words has one run: all its words."""
    n = np.diff(w.offsets)
    h = w.hashes
    if len(h) >= k:
        acc = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            acc += mix(h[j : len(h) - k + 1 + j], j + 1) * U(2 * j + 3)
        acc = mix(acc, k)
    else:
        acc = np.zeros(0, np.uint64)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(count)])
    if not len(h):
        return h, offsets
    doc = np.repeat(np.arange(len(n)), count)
    at = w.offsets[doc] + np.arange(offsets[-1]) - offsets[doc]
    short = (n > 0) & (n < k)
    out = acc[np.minimum(at, max(0, len(acc) - 1))] if len(acc) else np.zeros(len(at), np.uint64)
    for d in np.flatnonzero(short):
        own = h[w.offsets[d] : w.offsets[d + 1]]
        value = np.zeros(1, np.uint64)
        for j in range(len(own)):
            value += mix(own[j : j + 1], j + 1) * U(2 * j + 3)
        out[offsets[d]] = mix(value, 1000 + len(own))[0]
    return out, offsets


def gram_sets(w: Words, k: int) -> list[np.ndarray]:
    """Each document's distinct runs of k words, sorted."""
    flat, at = grams(w, k)
    return [np.unique(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def encoded(texts) -> list[bytes]:
    """UTF-8 of each text; nulls count as empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
