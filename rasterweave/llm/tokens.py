"""Token counts by offset-mapped attribution.

A whole document is encoded once by a byte-level BPE, whose tokens cover the text's bytes without gaps, so the running
sum of their byte lengths maps every token to a span. The spans are interval-joined to the document's sections (its
lines, or any spans in code points given as a column). A token that lies in one section counts there; a token that
crosses a boundary is allocated by RULE: "first" gives it to the section of its first byte, "most" to the section
with most of its bytes (the earlier of equals).

The vocabulary file is a parameter. The driver reads it and sends its bytes to the executors; a vocabulary is bounded.

Defined results: null and empty texts have one empty section of no tokens; sections may be empty; tokens whose
deciding byte is in no section count for section -1, which is given only if it has tokens; repeated rows each get their
rows; bytes that are no UTF-8 are read as U+FFFD; an empty table gives an empty result; other columns of docs, whatever
their names, are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that this vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(ranks: bytes, pattern: str = PATTERN) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """What encodes a text, and the byte length of every token."""
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    lengths = np.zeros(max(table.values()) + 1, np.int64)
    for token, rank in table.items():
        lengths[rank] = len(token)
    coding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return coding.encode_ordinary, lengths


def read(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def shipped(spark: SparkSession, path: str = VOCABULARY):
    """The vocabulary file as a broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def counted(docs: DataFrame, text: str, out: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with the column `text` replaced by `out`, its number of tokens (null text: 0)."""
    rest = [c for c in docs.columns if c != text]
    ranks = shipped(docs.sparkSession, vocabulary)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(ranks.value)
        for b in it:
            n = pa.array([len(encode(read(t.as_py()))) for t in b.column(text).cast(pa.binary())], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [n], names=[*rest, out])

    return docs.mapInArrow(batches, docs.select(*rest).schema.add(out, "long"))


def lines(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the lines; a line holds the \\n that ends it."""
    cuts = np.nonzero(np.frombuffer(raw, np.uint8) == 10)[0] + 1
    starts = np.concatenate([[0], cuts[cuts < len(raw)]])
    return starts, np.append(starts[1:], len(raw))


def allocate(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens of each section, those among them that cross one of its bounds, and tokens of no section.

    ends: running byte ends of the tokens; sections are sorted and don't overlap."""
    first = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    at = np.searchsorted(starts, first, "right") - 1
    if rule == "most" and len(starts):
        # The sections that a token meets lie side by side; each token's shares are compared one section after another.
        last = np.searchsorted(starts, np.maximum(ends - 1, 0), "right") - 1
        best, share = at.copy(), np.zeros(len(ends), np.int64)
        for step in range(int((last - at).max(initial=0)) + 1):
            k = np.minimum(at + step, last)
            part = np.where(k >= 0, np.minimum(ends, stops[k]) - np.maximum(first, starts[k]), 0)
            best, share = np.where(part > share, k, best), np.maximum(share, part)
        at = np.where(share > 0, best, -1)
    elif len(starts):
        at = np.where((at >= 0) & (first < stops[at]), at, -1)
    inside = at >= 0
    crossing = inside & ((ends > stops[at]) | (first < starts[at])) if len(starts) else inside
    n = len(starts)
    return np.bincount(at[inside], minlength=n), np.bincount(at[crossing], minlength=n), int((~inside).sum())


def attributed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows doc_id, section, start, stop (code points), n_tokens, n_crossing.

    sections: a column array<struct<start:int,stop:int>> of sorted spans that don't overlap; None: the lines."""
    if rule not in ("first", "most"):
        raise ValueError(rule)
    ranks = shipped(docs.sparkSession, vocabulary)
    kind = docs.schema[doc_id].dataType
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"), *([F.col(sections).alias("s")] if sections else []))
    names = ["section", "start", "stop", "n_tokens", "n_crossing"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(ranks.value)
        for b in it:
            parts: list[np.ndarray] = []
            rows: list[np.ndarray] = []
            spans = b.column(2).to_pylist() if sections else [None] * b.num_rows
            for k, (given_raw, given) in enumerate(zip(b.column(1).cast(pa.binary()), spans, strict=True)):
                t = read(given_raw.as_py())
                raw = t.encode()
                wide = len(t) < len(raw)  # else a byte is a code point
                chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, dtype=np.int32) if wide else None
                if given is None and not sections:
                    starts, stops = lines(raw)
                else:
                    heads = np.append(np.nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[0], len(raw)) if wide else np.arange(len(raw) + 1)
                    at = np.array([(x["start"], x["stop"]) for x in given or []], np.int64).reshape(-1, 2).clip(0, len(heads) - 1)
                    starts, stops = heads[at[:, 0]], heads[at[:, 1]]
                n, crossing, none = allocate(np.cumsum(lengths[encode(t)]) if t else np.zeros(0, np.int64), starts, stops, rule)
                before = lambda x: np.where(x > 0, chars[np.minimum(x, len(raw)) - 1], 0) if wide else x
                got = np.stack([np.arange(len(starts)), before(starts), before(stops), n, crossing], 1)
                if none:
                    got = np.concatenate([got, [[-1, 0, 0, none, 0]]])
                parts.append(got)
                rows.append(np.full(len(got), k))
            if parts:
                got = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(rows)))] + [pa.array(got[:, i], pa.int64()) for i in range(5)], names=["doc_id", *names])

    schema = own.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in names]).schema
    for field in schema.fields[1:]:
        field.nullable = True
    assert schema["doc_id"].dataType == kind
    return own.mapInArrow(batches, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(table(spark, sf_dir, "documents"))
