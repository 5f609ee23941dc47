"""Secret scans: fixed patterns, and random strings that a tokenizer can't shorten.

A vocabulary of byte pairs covers words, names and code in few tokens; random strings fall apart into about one token for
each one or two characters. Runs of characters that occur in secrets are encoded, and those with few characters per token
are reported, unless they are digests of a known length, UUIDs, numbers or identifiers made of words that the vocabulary
holds.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import arrow_slices, schema_with, small_batches, with_columns

#: Fixed values of the contract: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<kind:string,start:int,end:int>>"
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_DIGEST_SIZES = (32, 40, 56, 64, 96, 128)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Digests of a known length, UUIDs and numbers."""
    if _UUID.fullmatch(run) or _DIGEST.fullmatch(run) and len(run) in _DIGEST_SIZES:
        return True
    return sum(map(str.isalpha, run)) < len(run) // 4


def worded(run: str, path: str) -> bool:
    """Whether three quarters of the letters stand in words: separated or camel-case pieces of 3 letters and more that, as
    they are or in lower case, take a token for each 3 letters at most. Random letters hardly ever do, in whatever case; nor
    do long compounds in capitals, which are reported."""
    encode = _encoding(path).encode_ordinary
    words = sum(len(p) for p in _WORD.findall(run) if len(p) >= 3 and p.isalpha() and len(p) >= 3 * min(len(encode(x)) for x in (p, p.lower(), " " + p.lower())))
    return words > 0 and 4 * words >= 3 * sum(map(str.isalpha, run))


def scan(text: str, path: str, ratio: float) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start and then kind as in KINDS. An access key isn't also random."""
    found = []
    for kind, pattern, group, least in BASE:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), KINDS.index(kind), m.end()))
    for m in _RUN.finditer(text):
        run = m[0].strip("=-_/+")
        if len(run) >= 20 and not known(run) and len(run) < ratio * len(_encoding(path).encode_ordinary(run)) and not worded(run, path):
            at = m.start() + m[0].index(run)
            if not BASE[1][1].fullmatch(run):
                found.append((at, 3, at + len(run)))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def secret_spans(docs: DataFrame, text_col: str = "text", ratio: float = 2.2, path: str | None = None) -> DataFrame:
    """`docs` with column spans: array<struct<kind, start, end>> by start, then kind (assign, access, hex, random).

    Spans count code points of the whole text, end exclusive. Those of one kind don't overlap; those of different kinds may.
    `ratio`: fewer characters per token than that make a run of 20 or more characters random. Null and empty texts have no
    spans. A column of that name is replaced; rows that repeat are each scanned.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()
    keep = docs.select(*[c for c in docs.columns if c != "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in arrow_slices(batches, text_col):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t, path, ratio)] if t else [] for t in batch[text_col].to_pylist()]
            yield with_columns(batch, spans=pa.array(spans, kind))

    return keep.mapInArrow(run, schema_with(keep, f"spans {SPANS}"))


def _redacted(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for s in spans:
        if s["end"] > at:
            out += [text[at : max(at, s["start"])], mark if s["start"] >= at else ""]
            at = s["end"]
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mark: str = "[SECRET]", ratio: float = 2.2, path: str | None = None) -> DataFrame:
    """`docs` (with columns text and n_chars) with every span replaced by `mark`, overlapping ones by one, and n_chars set anew.

    Rows without spans stay as they are; no row goes.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text"):
            texts, sizes = batch["text"].to_pylist(), batch["n_chars"].to_pylist()
            for i, t in enumerate(texts):
                spans = [{"start": a, "end": b} for _, a, b in scan(t, path, ratio)] if t else []
                if spans:
                    texts[i] = _redacted(t, spans, mark)
                    sizes[i] = len(texts[i])
            new = {"text": pa.array(texts, batch["text"].type), "n_chars": pa.array(sizes, batch["n_chars"].type)}
            yield pa.RecordBatch.from_arrays([new.get(c, batch[c]) for c in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (joined) and n_random from `secret_spans`."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("random"))
