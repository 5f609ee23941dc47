"""Exact n-gram Jaccard self-join by metric windows, pivots and recursion.

Jaccard distance 1 - |x & y| / |x | y| and the set difference |x ^ y| are metrics on shingle sets; a link at similarity
p/q bounds both. The join uses them from the outside in:

1. Equal sets (distance 0) form a class; classes are joined, not documents.
2. The empty set is the first pivot: its distance is the set's size. Rings of sizes are as wide as a link reaches, so
   partners lie in the same ring or in neighbouring ones, and each class is replicated across the upper boundary of its
   ring.
3. In a ring the shingle space is cut into m parts by hash. |x ^ y| is the sum of the parts' differences, so by the
   triangle inequality a pair whose difference is at most K < m agrees wholly on m - K parts. Classes with an equal part
   share a region, whose centre is that part. With random pivots instead, nearly all texts have distance 1 to all
   pivots and nothing could be pruned; these regions keep unrelated texts apart whatever words are frequent.
4. A region's pivot is its least document. All members' distances to it are computed. Members linked with a pivot are in
   its component already. Where members of different components remain, the region is joined again: first with 16 more
   pivots, those of the smallest components, then with all members but the largest component's, always with members of
   other components only, and only those that the window |d(x, p) - d(y, p)| <= limit on the distances to
   the first pivot leaves. Then no unexamined pair of two components is left.

Parities of 1024 hash cells of a set differ in at most |x ^ y| places; pairs that differ in more than a link allows aren't
compared.

The parts that hold no shingle are equal too; m is raised so that e + 1 parts must agree, where more than e empty ones are
rare, and only sets with more than e empty parts use those.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .session import arrow_slices, settled, small_batches
from .textkit import U, encoded, gram_sets, mix, words

#: Pivots of a region in each further round; None: all members that aren't of its largest component.
_ROUNDS = (16, None)
#: Tasks among which the comparisons with one pivot are dealt.
_SALTS = 16
_WORDS = 16
#: Bits of the filter that marks texts to compare; its broadcast has at most a row for each 64 of them.
_MARKS = 1 << 25


class Rings:
    """Size rings of a threshold p/q, and the parts into which a ring's shingle space is cut."""

    def __init__(self, p: int, q: int) -> None:
        self.p, self.q = p, q
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, -(-self.starts[-1] * q // p)))
        self._parts: dict[int, tuple[int, int]] = {}

    def ring(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def parts(self, ring: int) -> tuple[int, int]:
        """(m, e) of a ring; (0, 0) where only equal sets can be linked."""
        if ring not in self._parts:
            top = self.starts[ring + 1] - 1
            most = 2 * top * (self.q - self.p) // (self.p + self.q)
            least, e = max(1, self.starts[ring] * self.p // self.q), 0
            for _ in range(4):
                m = most + 1 + e
                rare = m * math.exp(-least / m)
                e = max(e, math.ceil(rare + 3 * math.sqrt(rare)))
            self._parts[ring] = (most + 1 + e, e) if most else (0, 0)
        return self._parts[ring]

    def keys(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """The regions of each set, in its own ring and, as a guest, in the next."""
        owners, rings, ms, es = [], [], [], []
        for i, s in enumerate(sets):
            if len(s):
                own = self.ring(len(s))
                for r in (own, own + 1):
                    m, e = self.parts(r)
                    if m and not (r > own and len(s) * self.q < self.p * self.starts[r]):
                        owners.append(i)
                        rings.append(r)
                        ms.append(m)
                        es.append(e)
        if not owners:
            return [np.zeros(0, np.uint64) for _ in sets]
        base = np.concatenate([[0], np.cumsum(ms)])
        flat = np.concatenate([sets[i] for i in owners])
        sizes = [len(sets[i]) for i in owners]
        at = np.repeat(base[:-1], sizes) + (mix(flat, 5) % np.repeat(np.array(ms, np.uint64), sizes)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        total = np.concatenate([[U(0)], np.cumsum(mix(flat, 6)[order])])
        count = np.bincount(at, minlength=base[-1])
        bounds = np.concatenate([[0], np.cumsum(count)])
        part = np.arange(base[-1]) - np.repeat(base[:-1], ms)
        value = total[bounds[1:]] - total[bounds[:-1]] + mix(part.astype(np.uint64), 7) + np.repeat(mix(np.array(rings, np.uint64), 8), ms)
        value = mix(value, 9)
        found: list[list[np.ndarray]] = [[] for _ in sets]
        for j, i in enumerate(owners):
            a, b = base[j], base[j + 1]
            full = count[a:b] > 0
            found[i].append(value[a:b] if (~full).sum() > es[j] else value[a:b][full])
        return [np.concatenate(f) if f else np.zeros(0, np.uint64) for f in found]


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _parities(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((mix(s, 12) % U(64 * _WORDS)).astype(np.int64), minlength=64 * _WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(texts, k: int) -> list[np.ndarray]:
    return gram_sets(words(encoded(texts), lower=True), k)


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in arrow_slices(batches, "text"):
            sets = _sets(frame["text"].to_pylist(), k)
            columns = [frame["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_signature, sets), pa.binary()), pa.array(map(_parities, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "sig", "bits"])

    return run


def _alias(sig: bytes) -> int:
    """A short name of a class in the regions; classes that share one are told apart later."""
    return int.from_bytes(sig[:5], "big")


def _posted(k: int, rings: Rings, remember: int = 1 << 17):
    """(region, class) rows; the copies of a class in one task are posted once (as long as it is remembered)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for frame in arrow_slices(batches, "text"):
            fresh, names = [], []
            for s in _sets(frame["text"].to_pylist(), k):
                sig = _signature(s)
                if len(s) and sig not in seen:
                    if len(seen) >= remember:
                        seen.clear()
                    seen.add(sig)
                    fresh.append(s)
                    names.append(_alias(sig))
            keys = rings.keys(fresh)
            if fresh:
                alias = np.repeat(np.array(names, np.int64), [len(x) for x in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(alias)], ["key", "alias"])

    return run


def _compared(k: int):
    """Rows (pivot, salt, node, text), a pivot's own row first, into (node, pivot, shared, joint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot_sets = None, []
        for frame in arrow_slices(batches, "text"):
            out = []
            sets = _sets(frame["text"].to_pylist(), k)
            for p, salt, node, s in zip(*(frame[c].to_pylist() for c in ("pivot", "salt", "node")), sets, strict=True):
                if (p, salt) != key:
                    key, pivot_sets = (p, salt), []
                if node == p:
                    pivot_sets.append(s)
                    continue
                for own in pivot_sets:
                    shared = len(np.intersect1d(own, s, assume_unique=True))
                    out.append((node, p, shared, len(own) + len(s) - shared))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["node", "pivot", "shared", "joint"])

    return run


def _marked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts whose node is in `wanted`, and a few others: nodes are marked in a bitmap of fixed size, held as rows of 64
    bits, so that what is broadcast is bounded whatever the number of nodes. It spares a shuffle most texts."""
    at = F.pmod(F.xxhash64("node"), F.lit(_MARKS))
    bit = lambda df: df.withColumn("_word", F.shiftright(at, 6)).withColumn("_bit", at.bitwiseAND(F.lit(63)).cast("int"))
    bitmap = bit(wanted.select("node")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    return bit(texts).join(F.broadcast(bitmap), "_word").filter("getbit(_bits, _bit) = 1").select(*texts.columns)


def _verified(texts: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Exact set sizes for the distinct (node, pivot) pairs. A pivot's nodes are dealt to several tasks, each with a copy of the
    pivot. Only texts that pairs name are shuffled (but for chance hits in the bitmap), at every size alike."""
    dealt = pairs.select("pivot", F.pmod(F.hash("node"), F.lit(_SALTS)).alias("salt"), "node")
    wanted = dealt.union(dealt.select("pivot", "salt", F.col("pivot").alias("node")).distinct())
    rows = _marked(texts, wanted).join(wanted, "node").select("pivot", "salt", "node", "text")
    rows = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("node") != F.col("pivot"))
    return rows.mapInArrow(_compared(k), "node bigint, pivot bigint, shared bigint, joint bigint")


def _members(rows: DataFrame, classes: DataFrame, shingle: int, rings: Rings) -> DataFrame:
    """The classes of all regions that have two or more, with the region's first pivot and its size."""
    region = Window.partitionBy("key")
    posted = rows.filter("id IS NOT NULL").mapInArrow(_posted(shingle, rings), "key bigint, alias bigint")
    shared = posted.select("*", F.min("alias").over(region).alias("a"), F.max("alias").over(region).alias("b")).filter("a < b").select("key", "alias").distinct()
    named = shared.join(classes, "alias").select("key", "node", "n", F.min(F.struct("node", "n")).over(region).alias("first"))
    return settled(named.select("key", "node", "n", F.col("first.node").alias("pivot"), F.col("first.n").alias("pivot_n")))


def _first_pairs(members: DataFrame, classes: DataFrame, fits: str, near: Column) -> DataFrame:
    """The distinct pairs of a class and a region's first pivot that sizes and parities leave."""
    pairs = members.filter("node <> pivot").filter(fits).select("node", "n", "pivot", "pivot_n").distinct()
    own = classes.select("node", "bits")
    pairs = pairs.join(own, "node").join(own.toDF("pivot", "pb"), "pivot").filter(near)
    return settled(pairs.select("node", "pivot"))


def jaccard_groups(docs: DataFrame, shingle: int = 5, at_least: Fraction = Fraction(8, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id) for every row of `docs`, in no order.

    A document's set holds its distinct runs of `shingle` words (ASCII letters lower-cased, white space as in
    [\\x20\\x09-\\x0D]); with fewer words all of them form one; without words or text (null) it is empty. Documents link when
    the Jaccard similarity of their sets is `at_least` or more; an empty set links with nothing. component_id is the
    least id that links reach. Ties at the threshold count as links (the test is in integers). Rows that repeat an id
    are each returned; ids that come with several texts link by any of them. A row without id gets the component of the
    documents with its set, or null if they all lack ids. Other columns of `docs`, whatever their names, aren't read. An
    empty table gives no rows. Set sizes are exact; equality of sets is taken from 128-bit digests of 64-bit shingle hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    p, q = at_least.numerator, at_least.denominator
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rings = Rings(p, q)
    signed = settled(rows.mapInArrow(_signed(shingle), "id bigint, n bigint, sig binary, bits array<bigint>"))

    number = F.conv(F.substring(F.hex("sig"), 1, 10), 16, 10).cast("bigint")
    classes = settled(signed.filter("n > 0 AND id IS NOT NULL").groupBy("sig").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bits").alias("bits")).select("node", "n", number.alias("alias"), "bits"))
    members = _members(rows, classes.select("node", "n", "alias"), shingle, rings)
    texts = rows.filter("id IS NOT NULL").withColumnRenamed("id", "node")

    fits = lambda a, b: f"least({a}, {b}) * {q} >= greatest({a}, {b}) * {p}"
    apart = sum(F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("pb")[i])) for i in range(_WORDS))
    near = lambda a, b: apart * (p + q) <= (F.col(a) + F.col(b)) * (q - p)
    pairs = _first_pairs(members, classes, fits("n", "pivot_n"), near("n", "pivot_n"))
    seen = settled(_verified(texts, pairs, shingle))
    linked = lambda rows: rows.filter(f"shared * {q} >= joint * {p}").select("node", "pivot").distinct()
    labels = connected_components(linked(seen), "node", "pivot")

    # the first pivot of a region is examined, the others remain; without a distance their sizes or parities were apart
    first = seen.groupBy("node", "pivot").agg(F.min(1 - F.col("shared") / F.col("joint")).alias("d0"), F.max(1 - F.col("shared") / F.col("joint")).alias("d1"))
    left = members.filter("node <> pivot").join(first, ["node", "pivot"], "left").select("key", "node", "n", "d0", "d1")
    limit = float(1 - at_least) + 1e-9
    window = F.coalesce((F.col("d0") - F.col("p1") <= limit) & (F.col("p0") - F.col("d1") <= limit), F.lit(True))
    for pivots in _ROUNDS:
        known = labels.select("node", F.col("component").alias("label"))
        left = left.drop("label").join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = left.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("key")
        left = settled(left.join(mixed, "key", "left_semi"))
        if left.isEmpty():
            break
        now = left.join(classes.select("node", "bits"), "node")
        chosen = _pivots(left, pivots).join(classes.select(F.col("node").alias("pivot"), F.col("bits").alias("pb")), "pivot")
        pairs = now.join(chosen, "key").filter("label <> pl").filter(fits("n", "pn")).filter(window).filter(near("n", "pn"))
        pairs = pairs.select(F.greatest("node", "pivot").alias("node"), F.least("node", "pivot").alias("pivot")).distinct()
        pairs = settled(pairs.join(seen, ["node", "pivot"], "left_anti"))
        fresh = settled(_verified(texts, pairs, shingle))
        seen = seen.union(fresh)
        links = linked(fresh)
        if not links.isEmpty():
            labels = connected_components(links.union(labels), "node", "pivot")
        if pivots:
            left = left.join(chosen.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti")

    return _placed(signed, labels)


def _pivots(left: DataFrame, most: int | None) -> DataFrame:
    """(key, pivot, pn, p0, p1, pl): up to `most` members of each region, of its smallest components first; without a bound
    all but the members of its largest component."""
    share = left.groupBy("key", "label").agg(F.count("*").alias("size"))
    if most is None:
        largest = share.groupBy("key").agg(F.max(F.struct("size", "label"))["label"].alias("largest"))
        got = left.join(largest, "key").filter("label <> largest")
    else:
        order = [F.col("size"), F.col("node")]
        got = left.join(share, ["key", "label"]).withColumn("salt", F.pmod(F.hash("node"), F.lit(64)))
        # the first of each salt, then the first of those, so that a large region is sorted in parts
        got = got.withColumn("r", F.row_number().over(Window.partitionBy("key", "salt").orderBy(*order))).filter(F.col("r") <= most)
        got = got.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("r") <= most)
    return got.select("key", F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("d0").alias("p0"), F.col("d1").alias("p1"), F.col("label").alias("pl"))


def _placed(signed: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row with the component of its class."""
    nodes = signed.filter("n > 0").groupBy("sig").agg(F.min("id").alias("node"))
    reached = nodes.join(labels, "node", "left").select("sig", F.coalesce("component", "node").alias("component_id"))
    rows = signed.filter("n > 0").join(reached, "sig", "left").select("id", F.col("n").alias("n_shingles"), "component_id")
    return rows.union(signed.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
