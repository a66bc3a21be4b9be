"""Benchmark decontamination: a broadcast set of test n-grams, and a scan of every document's token windows.

Words of the test items get exact codes, so a window of codes is the window itself. A document's words are coded by
the same vocabulary in one pass; windows of known words whose rolling hash is in the sorted table of gram hashes are
verified against the grams. The driver builds the table of a block of items once, as arrays of some 25 bytes a word
beside the vocabulary, and broadcasts it; workers unpack it once, not once a task. The items' bytes are summed first
and dealt into blocks of at most BLOCK_BYTES; the documents pass through one scan a block, without a shuffle.

A document's result: its words, the merged word intervals under any occurring window, and the ids of items with
occurring windows. Documents may be dropped by the contamination rule, or the hit spans cut out.

Defined results: null text counts as empty and is never contaminated; an item without words never occurs; items with
the same id count once, a null id counts as the empty string; repeated documents each get their row; empty tables on
either side give no hits; bytes that are no UTF-8 are characters of words; all columns of docs, whatever their names,
are passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, quoted, table

WINDOW = 13
BLOCK_BYTES = 16_000_000
#: Rows are scanned so many words at a time.
CHUNK_WORDS = 500_000
#: A-Z to lower case, every other ASCII character that is no letter or digit to a space; other bytes stay.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STATE = "struct<n_words:bigint,spans:array<struct<s:int,e:int>>,items:array<string>>"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class Table:
    """The distinct grams of n codes, sorted by hash: where each stands in the codes, and the items that hold it."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, item: np.ndarray, n: int):
        h = rolling(codes, n)[starts]
        order = np.argsort(h, kind="stable")
        h, starts, item = h[order], starts[order], item[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        same = np.nonzero(~new)[0]
        for at in range(0, len(same), CHUNK_WORDS):  # of one hash, and yet another gram: both stay
            k = same[at : at + CHUNK_WORDS]
            new[k] = np.any([codes[starts[k] + j] != codes[starts[k - 1] + j] for j in range(n)], axis=0)
        first = np.nonzero(new)[0]
        pairs = np.unique(np.stack([np.cumsum(new) - 1, item], 1), axis=0) if len(h) else np.zeros((0, 2), np.int64)
        self.n, self.hashes, self.starts = n, h[first], starts[first]
        self.items, self.ends = pairs[:, 1].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(len(first)), "right")

    def found(self, own: np.ndarray, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, gram) of the windows of `own` at `at` that are grams."""
        h = rolling(own, self.n)[at]
        low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        out = [np.zeros((2, 0), np.int64)]
        for step in range(int((high - low).max(initial=0))):
            k = np.nonzero(low + step < high)[0]
            gram, place = low[k] + step, at[k]
            fine = np.ones(len(k), bool)
            for j in range(self.n):
                fine &= own[place + j] == codes[self.starts[gram] + j]
            out.append(np.stack([place[fine], gram[fine]]))
        return tuple(np.concatenate(out, axis=1))

    def holders(self, gram: int) -> np.ndarray:
        return self.items[self.ends[gram - 1] if gram else 0 : self.ends[gram]]


class Grams:
    """The grams of a block of items by length, over codes of the block's own vocabulary (0: any other word)."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        index = {x: i for i, x in enumerate(self.names)}
        parts, places, size = [], {}, 0
        for name, text in items:
            w = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)], np.int32)
            n = min(window, len(w))
            if n:
                places.setdefault(n, []).append((size, len(w) - n + 1, index[name]))
            parts.append(w)
            size += len(w)
        self.codes = np.concatenate([np.zeros(0, np.int32), *parts])
        self.tables = []
        for n, runs in sorted(places.items()):
            starts = np.concatenate([np.arange(s, s + k) for s, k, _ in runs])
            self.tables.append(Table(self.codes, starts, np.repeat([i for *_, i in runs], [k for _, k, _ in runs]), n))

    def hits(self, codes: np.ndarray) -> list[tuple[int, int, Table, int]]:
        """(start, end, table, gram) of the occurring windows."""
        found = []
        known = np.concatenate([[0], np.cumsum(codes != 0)])
        for t in self.tables:
            if len(codes) < t.n:
                continue
            at = np.nonzero(known[t.n :] - known[: -t.n] == t.n)[0]
            if len(at):
                found += [(i, i + t.n, t, g) for i, g in zip(*(x.tolist() for x in t.found(codes, self.codes, at)), strict=True)]
        return found


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every window of n codes."""
    c = codes.astype(np.uint64) * _BASE
    c ^= c >> np.uint64(29)
    size = len(c) - n + 1
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out *= _BASE
        out += c[k : k + size]
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def scan(texts: list[bytes | None], grams: Grams) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """(n_words, merged hit intervals, items) of every text; several texts share one vectorised step."""
    get, codes, ends = grams.vocabulary.get, [], []

    def flush() -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        array = np.array(codes, np.int32)
        hits = sorted(grams.hits(array), key=lambda h: h[0])
        start = k = 0
        for end in ends:  # each text ends with a code 0, which no window crosses
            spans, held = [], set()
            while k < len(hits) and hits[k][0] < end:
                spans.append((hits[k][0] - start, hits[k][1] - start))
                held.add(hits[k][2:])
                k += 1
            yield end - start, merged(spans), {grams.names[i] for t, g in held for i in t.holders(g).tolist()}
            start = end + 1
        codes.clear()
        ends.clear()

    for text in texts:
        codes += [get(w, 0) for w in words(text)]
        ends.append(len(codes))
        codes.append(0)
        if len(codes) > CHUNK_WORDS:
            yield from flush()
    yield from flush()


def blocks(items: DataFrame, item_id: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[bool, list[tuple[str, bytes | None]]]]:
    """The distinct items, in blocks of about `limit` bytes; one block at a time is on the driver."""
    own = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).cast("string").cast("binary").alias("t")).distinct()
    total = own.agg(F.sum(F.octet_length("t") + F.octet_length("i") + 64)).first()[0] or 0
    n = max(1, -(-total // limit))
    for k in range(n):
        part = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else own
        yield k + 1 == n, [(r.i, None if r.t is None else bytes(r.t)) for r in part.collect()]


def marked(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, limit: int = BLOCK_BYTES, texts: bool = True) -> DataFrame:
    """`__row` (a struct of the other columns of docs), `__text` (if asked for), and `__hits`: struct of n_words,
    spans (word intervals) and items."""
    rest = [col(c) for c in docs.columns if c != text] or [F.lit(True).alias("none")]
    got = docs.select(F.struct(*rest).alias("__row"), col(text).cast("string").alias("__text"), F.lit(None).cast(_STATE).alias("__hits"))
    for last, block in blocks(items, item_id, item_text, limit):
        shared = docs.sparkSession.sparkContext.broadcast(Grams(block, window))
        names = ["__row", "__text", "__hits"] if texts or not last else ["__row", "__hits"]

        def batches(it: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            grams = shared.value
            for b in it:
                out = []
                own = [t.as_py() for t in b.column(1).cast(pa.binary())]
                for old, (n, spans, found) in zip(b.column(2).to_pylist(), scan(own, grams), strict=True):
                    if old:
                        spans, found = merged([(x["s"], x["e"]) for x in old["spans"]] + spans), found | set(old["items"])
                    out.append({"n_words": n, "spans": [{"s": s, "e": e} for s, e in spans], "items": sorted(found)})
                kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("items", pa.list_(pa.string()))])
                hits = pa.array(out, kind)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), hits] if "__text" in names else [b.column(0), hits], names=names)

        got = got.mapInArrow(batches, got.select(*names).schema)
    return got


def n_hit() -> Column:
    return F.expr("aggregate(__hits.spans, 0L, (a, x) -> a + (x.e - x.s))")


def contaminated() -> Column:
    return (n_hit() > 0) & (n_hit() * 20 >= F.col("__hits.n_words"))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the word intervals, from the first byte of their first word to the last of their last."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORDS))]
    out, done = [], 0
    for s, e in spans:
        out.append(text[done : at[s][0]])
        done = at[e - 1][1]
    return b"".join([*out, text[done:]])


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", remove: str = "documents", **kw) -> DataFrame:
    """docs without contaminated documents (remove="documents"), or with every hit span cut out ("spans")."""
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    got = marked(docs, items, text, **kw)
    back = [F.col("__text").alias(c) if c == text else F.col(f"__row.{quoted(c)}").alias(c) for c in docs.columns]
    if remove == "documents":
        return got.where(~contaminated()).select(*back)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [t and cut(t, [(x["s"], x["e"]) for x in h["spans"]]) for t, h in zip((t.as_py() for t in b.column(1).cast(pa.binary())), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()).cast(pa.string()), b.column(2)], names=["__row", "__text", "__hits"])

    return got.mapInArrow(batches, got.schema).select(*back)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    got = marked(docs, items, texts=False)
    return got.select(
        F.col("__row.doc_id").alias("doc_id"),
        F.col("__hits.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("__hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__hits.items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


SQL = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
  b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
  bn as (select item_id, ws, least(len(ws), {WINDOW}) as k from b where len(ws) > 0),
  bw as (select distinct item_id, k, array_to_string(ws[i:i + k - 1], ' ') as g from (select item_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from bn)),
  dw as (select rid, i, k, array_to_string(ws[i:i + k - 1], ' ') as g from (select rid, ws, ks.k, unnest(range(1, len(ws) - ks.k + 2)) as i from d cross join (select distinct k from bn) ks where len(ws) >= ks.k)),
  hit as (select rid, i, dw.k, item_id from dw join bw on bw.k = dw.k and bw.g = dw.g),
  n as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + k)) as p from hit) group by rid),
  it as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct rid, cast(item_id as varchar) as item_id from hit) group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(ws) as contaminated
from d left join n on n.rid = d.rid left join it on it.rid = d.rid"""
