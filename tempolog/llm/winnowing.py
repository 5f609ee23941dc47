"""Document fingerprints by winnowing, as Spark expressions.

A text's k-grams of code points are hashed. In every window of w neighbouring hashes the least is chosen, the rightmost of
equal ones; the chosen hashes with their positions are the fingerprint. Two texts that share w + k - 1 code points in a
row share a chosen hash, and its positions tell where. Long texts are cut into blocks with enough of their surroundings
that each block knows all windows of its own positions, so a block bounds the memory of one step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BITS = 21
_BLOCK = 1 << 20
_LOW = (1 << _BITS) - 1
_MOST_RANGES = 1 << 18


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _joined(offsets: range):
    """Each element's least with the elements that many places further."""
    return lambda a: F.transform(a, lambda x, i: F.least(x, *[F.get(a, i + j) for j in offsets]))


def _minima(points: Column, n: Column, k: int, window: int, first: Column | None = None) -> Column:
    """Per window of a text (its UTF-32 bytes and length) the least hash with its position, as one number.

    The position, counted from `first`, stands in the low bits from the right: of equal hashes the rightmost is least.
    """
    grams = F.greatest(F.lit(1), n - (k - 1))
    first = F.lit(0) if first is None else first
    keys = F.transform(F.sequence(F.lit(0), grams - 1), lambda i: F.xxhash64(F.substring(points, i * 4 + 1, 4 * k)).bitwiseAND(F.lit(~_LOW)).bitwiseOR((F.lit(_LOW) - first - i).cast("bigint")))
    step = 1
    while step < window:
        # least() leaves out the nulls that get() gives beyond the end
        times = min(4, window // step)
        keys = _let(keys, _joined(range(step, step * times, step)))
        step *= times
    return F.slice(keys, 1, F.greatest(F.lit(1), grams - (window - 1)))


def _blocks(text: Column, k: int, window: int) -> Column:
    """All chosen numbers of a text longer than a block, with positions split off."""
    n = F.char_length(text)
    grams = n - (k - 1)

    def block(b: Column) -> Column:
        own = b * _BLOCK
        start = F.greatest(F.lit(0), own - (window - 1))
        size = F.least(grams, own + _BLOCK + window - 1) - start + k - 1
        found = _let(F.encode(F.substring(text, start + 1, size), "UTF-32"), lambda p: _split(F.array_distinct(_minima(p, size, k, window)), start))
        return F.filter(found, lambda x: (x["pos"] >= own) & (x["pos"] < own + _BLOCK))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((grams - 1) / _BLOCK).cast("int")), block))


def _split(numbers: Column, start: Column | None = None) -> Column:
    return F.transform(numbers, lambda x: F.struct((F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW)) + (F.lit(0) if start is None else start)).cast("bigint").alias("pos"), F.shiftright(x, _BITS).alias("hash")))


def _none() -> Column:
    return F.array().cast("array<struct<pos:bigint,hash:bigint>>")


def chosen(text: Column, k: int = 8, window: int = 16) -> Column:
    """array<struct<pos bigint, hash bigint>> of a text, by position (from 0). Null and empty texts give an empty array.

    A text shorter than k is one gram; one with fewer than `window` grams is one window. `window` is 1, 2 or a multiple of
    4 that halves down to 1.
    """
    text = F.coalesce(text, F.lit(""))
    n = F.char_length(text)
    short = _let(F.encode(text, "UTF-32"), lambda p: _split(F.array_distinct(_minima(p, n, k, window))))
    return F.when(n == 0, _none()).when(n <= _BLOCK, short).otherwise(_blocks(text, k, window))


def chosen_twice(text: Column, edited: Column, same: Column, k: int = 8, window: int = 16) -> Column:
    """struct<own, edited>: `chosen` of a text and of another that begins with the same `same` code points.

    Windows inside the common beginning are taken over, not computed again.
    """
    n, m = F.char_length(text), F.char_length(edited)
    taken = F.greatest(F.lit(0), same - (k + window - 2))
    rest = F.when((taken > 0) & (m == same), F.array().cast("array<bigint>")).otherwise(
        _let(F.encode(F.substring(edited, taken + 1, m), "UTF-32"), lambda p: _minima(p, m - taken, k, window, taken))
    )
    short = _let(
        _let(F.encode(text, "UTF-32"), lambda p: _minima(p, n, k, window)),
        lambda a: F.struct(_split(F.array_distinct(a)).alias("own"), F.when(m == 0, _none()).otherwise(_split(F.array_distinct(F.concat(F.slice(a, 1, taken), rest)))).alias("edited")),
    )
    apart = F.struct(chosen(text, k, window).alias("own"), chosen(edited, k, window).alias("edited"))
    return F.when((n > 0) & (n <= _BLOCK), short).otherwise(apart)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def digest(fingerprint: Column) -> Column:
    """128 bits over hashes and positions, in hexadecimal."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), fingerprint)), 16, "0") for seed in ("a", "b")]))


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = 8, window: int = 16) -> DataFrame:
    """`docs` with column fingerprint (see `chosen`), which is replaced if there is one."""
    return docs.withColumn("fingerprint", chosen(F.col(text_col), k, window))


def _longs(values: list[int]) -> Column:
    """An array of numbers as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_next(docs: DataFrame, rows_each: int = 1_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """Rows (id, text, next, guest), next being the text of the next row by ascending id, and the window that found it.

    Rows without id come first; equal ids are ordered by text; after the last row comes the first that has an id. The ids
    are cut at quantiles into ranges of about `rows_each` rows (at most 2^18 ranges, so that the cuts, which go with the plan,
    take 2 MB at most; beyond 2^18 * rows_each rows the ranges grow); the row that begins a range is also dealt,
    as a guest, to the range before, so that no task sees more than a range and nothing is sorted as a whole.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    count = base.select("id").agg(F.count("*").alias("n"), F.min("id").alias("least")).first()
    ranges = max(1, min(_MOST_RANGES, count["n"] // rows_each))
    cuts: list[int] = []
    if ranges > 1:
        steps = [i / ranges for i in range(1, ranges)]
        got = base.select(F.percentile_approx("id", steps, max(10_000, 4 * ranges))).first()[0] or []
        cuts = sorted({c for c in got if c > count["least"]})
    if cuts:
        # the page of cuts first, then the place in it; each list is one literal, however long
        each = math.isqrt(len(cuts)) + 1
        page = F.size(F.filter(_longs(cuts[::each]), lambda c: c <= F.col("id")))
        within = F.slice(_longs(cuts), F.greatest(F.lit(0), page - 1) * each + 1, each)
        place = F.when(F.coalesce(page, F.lit(0)) <= 0, 0).otherwise((page - 1) * each + F.size(F.filter(within, lambda c: c <= F.col("id"))))
        begins = F.exists(within, lambda c: c == F.col("id"))
        homes = F.when((page > 0) & begins, F.array(F.struct(place.alias("range"), F.lit(0).alias("guest")), F.struct((place - 1).alias("range"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(place.alias("range"), F.lit(0).alias("guest"))))
    else:
        homes = F.array(F.struct(F.lit(0).alias("range"), F.lit(0).alias("guest")))
    around = F.array(F.struct(F.lit(len(cuts)).alias("range"), F.lit(2).alias("guest")))
    homes = F.when(F.col("id") == F.lit(count["least"]), F.concat(homes, around)).otherwise(homes)
    dealt = base.withColumn("home", F.explode(homes)).select("id", "text", "home.range", "home.guest")
    order = Window.partitionBy("range").orderBy("guest", F.col("id").asc_nulls_first(), "text")
    return dealt.withColumn("next", F.lead("text").over(order)), order


def edited_fingerprints(docs: DataFrame, k: int = 8, window: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of `docs`: id, text, edited (its last quarter replaced by the beginning of the next row's text),
    fingerprint, edited_fingerprint, near_edited and near_next (likeness of the fingerprint to the edited text's and to the
    next row's). Null texts count as empty; repeated rows are each returned; other columns aren't read. Without a row that
    has an id, the last row's next text is empty."""
    rows, order = with_next(docs, id_col=id_col, text_col=text_col)
    text = F.coalesce("text", F.lit(""))
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    rows = rows.select("id", text.alias("text"), "range", "guest", edited.alias("edited"), (n - cut).alias("same"))
    rows = rows.withColumn("both", chosen_twice(F.col("text"), F.col("edited"), F.col("same"), k, window))
    rows = rows.select("*", F.col("both.own").alias("fingerprint"), F.col("both.edited").alias("edited_fingerprint")).drop("both")
    hashes = lambda c: F.array_distinct(F.transform(c, lambda x: x["hash"]))
    rows = rows.withColumn("own", hashes(F.col("fingerprint")))
    rows = rows.withColumn("next_own", F.lead("own").over(order)).filter("guest = 0")
    none = F.array().cast("array<bigint>")
    return rows.select("id", "text", "edited", "fingerprint", "edited_fingerprint", likeness(F.col("own"), hashes(F.col("edited_fingerprint"))).alias("near_edited"), likeness(F.col("own"), F.coalesce("next_own", none)).alias("near_next"))
