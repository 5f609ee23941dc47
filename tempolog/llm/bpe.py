"""Byte-level BPE by overlapping chunks.

Merges never cross pre-tokens, and where a pre-token ends depends only on the text from its beginning on. So a text can
be pre-tokenised in chunks that overlap: from the first boundary that two neighbouring chunks share, both go on alike, and
they are stitched there. Each chunk's pre-tokens are then encoded by themselves. Texts up to a chunk are one piece; the
chunks of longer ones are dealt over all tasks, and stitched by document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import arrow_slices, schema_with, small_batches, with_columns

CHUNK = 1 << 15
OVERLAP = 1 << 10
#: A pre-token that ends this near to a chunk's end may go on beyond it.
MARGIN = 4


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """Pre-tokens to ids, with a bounded memory of the pre-tokens seen, and ids to bytes."""

    def __init__(self, path: str, pat: str, most: int = 200_000) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pat)
        self.encoding = tiktoken.Encoding("bpe", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()}
        self.seen: dict[str, tuple[int, ...]] = {}
        self.most = most

    def piece(self, p: str) -> tuple[int, ...]:
        got = self.seen.get(p)
        if got is None:
            got = tuple(self.encoding.encode_ordinary(p))
            if len(p) <= 32:
                if len(self.seen) >= self.most:
                    self.seen.clear()
                self.seen[p] = got
        return got

    def encode(self, text: str) -> list[int]:
        seen, piece = self.seen, self.piece
        out: list[int] = []
        for p in self.find.findall(text):
            out += seen.get(p) or piece(p)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@cache
def codec(path: str, pat: str) -> Codec:
    return Codec(path, pat)


def chunk_pieces(c: Codec, part: str, last: bool) -> list[int]:
    """Ends of the pre-tokens of a chunk that its end can't have changed."""
    limit = len(part) if last else len(part) - MARGIN
    return [m.end() for m in c.find.finditer(part) if m.end() <= limit]


def stitched(chunks: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int]] | None:
    """(chunk, from, to): the ranges of code points that each chunk contributes, from sorted (start, boundaries) of chunks,
    with boundaries counted in the text. None if neighbours share no boundary."""
    out, at = [], 0
    for i, (_, own) in enumerate(chunks):
        if i + 1 < len(chunks):
            shared = np.intersect1d(own[own >= at], chunks[i + 1][1], assume_unique=True)
            if not len(shared):
                return None
            to = int(shared[0])
        else:
            to = int(own[-1]) if len(own) else at
        out.append((i, at, to))
        at = to
    return out


def _lists(ids: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, pat: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """`docs` with column ids: array<int>, the text's tokens as the tiktoken library's encode_ordinary gives them.

    Null and empty texts have no tokens. A column of that name is replaced, others stay whatever their names; repeated rows are
    each returned. Texts longer than `chunk` code points are dealt as chunks with `overlap` code points of the next; where
    neighbours share no boundary in the overlap (such as within one run of letters that is longer) the text is encoded as one
    chunk. Rows come in no order.
    """
    from .secrets import tokenizer_path

    small_batches(docs.sparkSession)
    path, pat = path or tokenizer_path(), pat or pattern()
    keep = docs.select(*[c for c in docs.columns if c.lower() != "ids"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pat)
        for batch in arrow_slices(batches, text_col):
            yield with_columns(batch, ids=_lists([c.encode(t) if t else [] for t in batch[text_col].to_pylist()]))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pat)
        for batch in arrow_slices(batches, "part"):
            ends, ids, counts = [], [], []
            for part, start, last in zip(*(batch[x].to_pylist() for x in ("part", "start", "last")), strict=True):
                e = chunk_pieces(c, part, last)
                tokens = [c.piece(part[a:b]) for a, b in zip([0, *e][: len(e)], e, strict=True)]
                ends.append(np.array([start, *(start + x for x in e)], np.int64))
                counts.append(np.array([len(t) for t in tokens], np.int32))
                ids.append(np.fromiter((i for t in tokens for i in t), np.int32))
            yield pa.RecordBatch.from_arrays([batch["name"], batch["start"], *(pa.array(x, pa.list_(t)) for x, t in ((ends, pa.int64()), (counts, pa.int32()), (ids, pa.int32())))], ["name", "start", "ends", "counts", "ids"])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        rest = frame.sort_values("start")
        got = stitched(list(zip(rest["start"], rest["ends"], strict=True)))
        ids = None
        if got is not None:
            cut = []
            for (_, a, b), ends, counts, tokens in zip(got, rest["ends"], rest["counts"], rest["ids"], strict=True):
                at = np.concatenate([[0], np.cumsum(counts)])
                i, j = np.searchsorted(ends, [a, b])
                cut.append(tokens[at[i] : at[j]])
            ids = np.concatenate(cut)
        return pd.DataFrame({"name": frame["name"].iloc[:1], "stitched": [ids]})

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pat)
        for batch in arrow_slices(batches, "text"):
            ids = batch["stitched"]
            if ids.null_count:
                ids = _lists([c.encode(t) if i is None else i for t, i in zip(batch["text"].to_pylist(), ids.to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch["row"], ids, batch["times"]], ["row", "ids", "times"])

    size = F.char_length(F.col(text_col))
    short = keep.filter(F.coalesce(size <= chunk, F.lit(True))).mapInArrow(whole, schema_with(keep, "ids array<int>"))
    # a row's name within the table: all of its values; equal rows share their chunks
    values = F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(keep.columns)])
    long = keep.filter(size > chunk).select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.sha2(F.to_json(values), 256).alias("name"))
    same = long.groupBy("name").agg(F.count("*").alias("times"), F.first("row").alias("row"), F.first("text").alias("text"))
    n = F.char_length("text")
    cuts = same.select("name", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).alias("i"))
    cuts = cuts.select("name", (F.col("i") * chunk).cast("bigint").alias("start"), F.substring(F.col("text"), F.col("i") * chunk + 1, F.lit(chunk + overlap)).alias("part"), (F.col("i") * chunk + chunk + overlap >= F.col("n")).alias("last"))
    done = cuts.repartition("name", "start").mapInArrow(parts, "name string, start bigint, ends array<bigint>, counts array<int>, ids array<int>")
    ids = done.groupBy("name").applyInPandas(joined, "name string, stitched array<int>")
    both = same.join(ids, "name").select("row", "text", "stitched", "times")
    both = both.mapInArrow(filled, schema_with(both.select("row"), "ids array<int>, times bigint"))
    repeated = both.select("row", "ids", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*", "ids")
    return short.unionByName(repeated)


def decoded(ids: Column, path: str | None = None, pat: str | None = None) -> Column:
    """The bytes of token ids, joined; binary, as tokens may split characters. Null for null."""
    from .secrets import tokenizer_path

    path, pat = path or tokenizer_path(), pat or pattern()

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        c = codec(path, pat)
        return x.map(lambda i: None if i is None else c.decode(i))

    return run(ids)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by spaces, lower-case hexadecimal."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)
