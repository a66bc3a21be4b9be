"""Packing by optimal length buckets.

Texts become token sequences, longer ones several segments of at most `longest` tokens. The global histogram of
segment lengths, at most longest + 1 rows whatever the corpus, goes to the driver, where dynamic programming over it
chooses the bucket bounds with the least padding. In a bucket, batches of `budget // bound` segments fill one after
another: segments are dealt by hash into groups of about sqrt(rows), numbered inside their group, and shifted by the
running count of the groups before, so every batch but a bucket's last is full and no bucket is ever in one task.

Only ids and lengths are shuffled. They are kept in the checkpoint folder, so texts are encoded once.

Defined results: null and empty texts give one segment of no tokens; repeated rows and equal lengths each get their
place, in order of id, segment, length and row; bytes that are no UTF-8 count as U+FFFD; an empty table gives an empty result; other columns of docs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, col, joined, table
from .tokens import VOCABULARY, counted, encoder, read, shipped

LONGEST, BUDGET, BUCKETS = 2048, 65_536, 16
#: A group that is numbered in one task has about so many rows, or the square root of all rows if that is more.
GROUP = 1000


def bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The upper bounds of at most `buckets` buckets over the lengths that pad least (fewest buckets among equals)."""
    lengths = np.array(sorted(histogram), np.int64)
    n = len(lengths)
    if not n:
        return []
    counts = np.concatenate([[0], np.cumsum([histogram[int(x)] for x in lengths])])
    best = lengths * counts[1:]  # slots that lengths up to the j-th take in one bucket
    choice = [np.zeros(n, np.int64)]
    for _ in range(min(buckets, n) - 1):
        before = np.concatenate([[0], best])  # before[i]: of the first i lengths
        now, at = np.empty(n, np.int64), np.empty(n, np.int64)
        for j in range(n):
            cost = before[: j + 1] + lengths[j] * (counts[j + 1] - counts[: j + 1])
            at[j] = cost.argmin()
            now[j] = cost[at[j]]
        if now[-1] >= best[-1]:
            break
        best = now
        choice.append(at)
    out, j = [], n
    for at in reversed(choice):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(at[j - 1])
    return out[::-1]


def segments(docs: DataFrame, doc_id: str, n_tokens: str, longest: int = LONGEST) -> DataFrame:
    """Rows doc_id, segment, start_token, n_tokens (and row, if docs has it): every sequence cut after each `longest` tokens."""
    row = ["row"] if "row" in docs.columns else []
    got = docs.select(F.col(doc_id).alias("doc_id"), *row, F.col(n_tokens).cast("long").alias("__n"))
    got = got.withColumn("segment", F.explode(F.expr(f"sequence(0L, greatest(0L, (__n - 1) div {longest}))")))
    return got.select("doc_id", *row, "segment", F.expr(f"segment * {longest}").alias("start_token"), F.expr(f"least(__n - segment * {longest}, {longest})").alias("n_tokens"))


def packed(segs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """segs (doc_id, segment, start_token, n_tokens, and row if repeated ids are to be dealt out; read several times)
    with bucket_length and batch.

    A batch holds bucket_length * its rows <= budget slots, or a single row if the bucket is longer than the budget."""
    histogram = {r.n_tokens: r["count"] for r in segs.groupBy("n_tokens").count().collect()}
    cuts = bounds(histogram, buckets) or [0]
    total = sum(histogram.values())
    size = max(GROUP, isqrt(total))
    inside = [sum(c for n, c in histogram.items() if low < n <= high) for low, high in zip([-1, *cuts], cuts)]
    pick = lambda values: F.expr("case " + " ".join(f"when n_tokens <= {b} then {v}" for b, v in zip(cuts, values, strict=True)) + " end")
    salt = ["row"] if "row" in segs.columns else []
    own = segs.withColumn("bucket_length", pick([f"{b}L" for b in cuts]))
    own = own.withColumn("__g", F.pmod(F.xxhash64("doc_id", "segment", "n_tokens", *salt), pick([-(-c // size) or 1 for c in inside])))
    sizes = own.groupBy("bucket_length", "__g").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(F.col("bucket_length").alias("__b"), F.col("__g").alias("__og"), (F.sum("n").over(Window.partitionBy("bucket_length").orderBy("__g")) - F.col("n")).alias("__offset"))
    place = F.row_number().over(Window.partitionBy("bucket_length", "__g").orderBy("doc_id", "segment", "n_tokens", *salt))
    own = joined(own.withColumn("__place", place), checkpointed(offsets), [("bucket_length", "__b"), ("__g", "__og")], "inner")
    batch = F.expr(f"(__offset + __place - 1) div greatest(1, {budget} div greatest(1, bucket_length))")
    return own.select("doc_id", "segment", "start_token", "n_tokens", "bucket_length", batch.alias("batch"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, budget: int = BUDGET, buckets: int = BUCKETS, vocabulary: str = VOCABULARY) -> DataFrame:
    own = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("__text"))
    # The row's number is kept with the counts, so that repeated ids, even a third of all rows, are dealt out.
    own = checkpointed(counted(own, "__text", "__n_tokens", vocabulary).withColumn("row", F.monotonically_increasing_id()))
    return packed(segments(own, "doc_id", "__n_tokens", longest), budget, buckets)


def tokenised(packing: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, vocabulary: str = VOCABULARY) -> DataFrame:
    """What a trainer reads: the rows of pack() (doc_id unique) with `tokens`, the token ids of each segment.

    Texts are encoded once more, on the side that holds them; the batches' rows are joined by id and segment."""
    ranks = shipped(docs.sparkSession, vocabulary)
    own = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("__text"))
    schema = own.select("doc_id", F.lit(None).cast("long").alias("segment"), F.lit(None).cast("array<int>").alias("tokens")).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(ranks.value)
        for b in it:
            ids, numbers, tokens = [], [], []
            for k, t in enumerate(b.column(1).cast(pa.binary())):
                all_of = encode(read(t.as_py()))
                for n, at in enumerate(range(0, max(1, len(all_of)), longest)):
                    ids.append(k)
                    numbers.append(n)
                    tokens.append(all_of[at : at + longest])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(numbers, pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], names=["doc_id", "segment", "tokens"])

    made = own.mapInArrow(batches, schema).withColumnsRenamed({"doc_id": "__d", "segment": "__s"})
    return packing.join(made, packing["doc_id"].eqNullSafe(made["__d"]) & (packing["segment"] == made["__s"])).drop("__d", "__s")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
