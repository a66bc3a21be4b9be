"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits over the XXH64 values of a text's shingles. Two fingerprints within three bits of each other
have a 32-bit half in which they differ in one bit at most. So every distinct fingerprint enters a table under both
halves, and looks up the Hamming ball of radius one around each half. A ball is enumerated by clearing set bits only:
of two values one bit apart, the one with the bit set finds the other. The lookups that meet a table entry form small
buckets, in which complete distances are verified.

A bucket gives a spanning forest of its true links, never all pairs, so a group of near copies costs as many rows as
it has fingerprints. Copies share one fingerprint and are one row from the start. A bucket beyond BUCKET entries is
split by the ball of radius one around the 16-bit quarters of the other half (two texts that share a half up to a bit
have a quarter of the other half within a bit), which leaves 16 free bits a bucket.

near_copies() is for texts with a similarity of 0.8 or more in five-word shingles. Two such fingerprints differ in 15 of
100 bits, whichever words differ, so three of 64 bits don't find them. There the same fingerprint has 2048 bits and the
same multi-index has TABLES tables instead of two: each is over 24 or more of the bits, two texts meet if those are
equal, and a pair at 0.8 is missed by all with a chance of 2e-5. Its nodes are the distinct shingle sets. Pairs that
meet are verified by their complete distances, which gives neighbourhoods; inside each, nodes are linked if their shingle
sets themselves are alike to 0.8 or more.

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked like any other;
repeated rows (same id or same text) each get their row; a null id is ignored when the smallest id of a component is
taken, and a component of null ids only has a null id; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, col, dropped, joined, quoted, table, tidy
from .components import components

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: For near copies: words of a shingle (the distance is not used: they are told by their similarity).
WIDE_SHINGLE, WIDE_DISTANCE = 5, 50
#: Bits of a wide fingerprint, and tables over some of them each: with 24 bits a pair at a similarity of 0.8, which differs
#: in 15.15 % of the bits, meets in none with a chance of 2e-5.
WIDE_BITS, TABLES = 2048, 720
#: Bits of a table for up to 2 ** 15 nodes; each doubling takes a bit more, and tables in proportion to the chance of a bit.
TABLE_BITS, AGREE = 24, 0.8485
#: The least similarity of near copies, as a fraction.
SIMILARITY = (4, 5)
#: Differing bits of 2048 above which a pair is not at 0.8 (on average 310, deviation 16).
MOST = 430
#: Entries of the tables that are dealt out at once take about so many bytes a pass, if that is no more than PASSES.
PASS_BYTES, PASSES, GROUP_ROWS = 200_000_000, 6, 2_000_000
#: So many tables come first.
FIRST = 24
#: SQL for the differing bits of fingerprints sa and sb.
APART = "aggregate(zip_with(sa, sb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
MIX = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, (2, WIDE_BITS // 64), np.uint64) | np.uint64(1)
BUCKET = 4096
#: Rows that are compared in one task: at most about so many bytes, and so many rows, a side.
GROUP_BYTES, SIDE = 32_000_000, 4096
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    words = (text or b"").translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= size:
        shingles = [line]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        shingles = [line[s : e - 1] for s, e in zip([0, *ends[: n - size]], ends[size - 1 :], strict=True)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE, out: str = "fp") -> DataFrame:
    """docs with the column `text` replaced by `out`, the fingerprint as a signed long."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).schema.add(out, "long")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(text).cast(pa.large_binary()) if not pa.types.is_string(b.column(text).type) else b.column(text).cast(pa.binary())
            fp = np.array([fingerprint(t.as_py(), size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(fp, pa.int64())], names=[*rest, out])

    return docs.mapInArrow(batches, schema)


def forest(values: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links within `distance` bits that span the same components as all such links of the values."""
    left, found = values, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue[-1]) <= distance
            here = queue.pop()
            if near.any():
                found += [(int(here), int(v)) for v in left[near]]
                queue += list(left[near])
                left = left[~near]
    return found


def _ball(value: str, bits: int, tag: str) -> str:
    """SQL for the entries (part, key) of a table value and its lookups with one set bit cleared; own: the table entry."""
    return (
        f"concat(array(struct({tag} as part, {value} as key, true as own)), transform(filter(sequence(0, {bits - 1}),"
        f" b -> getbit({value}, b) = 1), b -> struct({tag} as part, {value} - shiftleft(1L, b) as key, false as own)))"
    )


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between the distinct values of fps (column fp) that span all links within `distance` (at most 3) bits."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves and a ball of radius one find up to three differing bits")
    high, low = "shiftrightunsigned(fp, 32)", "(fp & 4294967295L)"
    entries = fps.select("fp", F.explode(F.expr(f"concat({_ball(high, 32, '0')}, {_ball(low, 32, '1')})")).alias("e")).select("fp", "e.*")
    met = entries.join(entries.where("own").select("part", "key").distinct(), ["part", "key"], "left_semi")
    sizes = met.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = checkpointed(met.join(sizes, ["part", "key"]).select("part", "key", "fp", "n"))
    small = met.where(F.col("n") <= BUCKET)
    other = f"if(part = 0, {low}, {high})"
    q0, q1 = f"shiftrightunsigned({other}, 16)", f"({other} & 65535L)"
    large = met.where(F.col("n") > BUCKET).select("part", "key", "fp", F.explode(F.expr(f"concat({_ball(q0, 16, '0')}, {_ball(q1, 16, '1')})")).alias("e"))
    large = large.select(F.expr("2 + 2 * part + e.part").alias("part"), F.expr("shiftleft(key, 16) | e.key").alias("key"), "fp")
    buckets = small.select("part", "key", "fp").union(large).groupBy("part", "key").agg(F.collect_set("fp").alias("fps"))
    buckets = buckets.where(F.size("fps") > 1)
    pairs = buckets.where(F.size("fps") == 2).select(F.col("fps")[0].alias("a"), F.col("fps")[1].alias("b"))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)

    def spanned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for fps in b.column(0):
                got = forest(np.sort(fps.values.to_numpy(zero_copy_only=False).view(np.uint64)), distance)
                at = np.array(got, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int64()), pa.array(at[:, 1], pa.int64())], names=["a", "b"])

    return pairs.union(buckets.where(F.size("fps") > 2).select("fps").mapInArrow(spanned, "a long, b long")).distinct()


def shingle_hashes(text: bytes | None, size: int = WIDE_SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or b"").translate(LOWER).split()
    n = len(words)
    line, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    shingles = [line[s : e - 1] for s, e in zip([0, *ends[: n - size]], ends[size - 1 :], strict=True)] if n > size else [line] * (n > 0)
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64, len(shingles)))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of WIDE_BITS bits of a set of shingle hashes: a bit is 1 if set in over half of the mixed hashes."""
    ones = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(hashes), 255):
        x = (hashes[at : at + 255, None] ^ MIX[0]) * MIX[1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)


@cache
def tables_for(n: int) -> tuple[int, int]:
    """(tables, bits of each) for n nodes: unlike texts hardly meet, and a pair at 0.8 meets as surely for any n."""
    bits = min(32, TABLE_BITS + max(0, (max(n, 1) - 1).bit_length() - 15))
    return round(TABLES / AGREE ** (bits - TABLE_BITS)), bits


@cache
def _places(tables: int, bits: int) -> np.ndarray:
    """The bits of each table, and places of no bit up to 32."""
    r = np.random.Generator(np.random.PCG64(SEED + bits))
    own = np.full((tables, 32), WIDE_BITS)
    for row in own:
        row[:bits] = r.choice(WIDE_BITS, bits, replace=False)
    return own


def table_keys(sigs: np.ndarray, tables: int, bits: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The keys of fingerprints (a row each) in the tables from first to before last."""
    at = _places(tables, bits)[first:last]
    out = np.empty((len(sigs), len(at)), np.uint32)
    for k in range(0, len(sigs), 256):
        one = np.unpackbits(np.ascontiguousarray(sigs[k : k + 256]).view(np.uint8), axis=1, bitorder="little")
        one = np.concatenate([one, np.zeros((len(one), 1), np.uint8)], axis=1)
        out[k : k + 256] = np.ascontiguousarray(np.packbits(one.take(at.ravel(), 1), axis=1, bitorder="little")).view(np.uint32)
    return out


def _sigs(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WIDE_BITS // 64)


def wide_rows(docs: DataFrame, text: str, size: int = WIDE_SHINGLE) -> DataFrame:
    """docs with the column `text` replaced by fp, a hash of the shingle set, and sig, its wide fingerprint."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest, F.lit(0).cast("long").alias("fp"), F.lit(None).cast("array<long>").alias("sig")).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = [shingle_hashes(t.as_py(), size) for t in batch.column(text).cast(pa.binary())]
            fp = np.array([xxhash.xxh3_64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            sig = np.concatenate([wide_fingerprint(h) for h in sets]) if sets else np.zeros(0, np.int64)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sig) + 1, WIDE_BITS // 64), pa.int32()), pa.array(sig))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(fp), sig], names=[*rest, "fp", "sig"])

    return docs.mapInArrow(batches, schema)


def met_in_tables(reps: DataFrame, tables: int, bits: int, first: int, last: int, parts: int) -> DataFrame:
    """(key, fp, hub): what met in the tables from first to before last and has several roots (reps: fp, sig, root). One
    node of each root of a bucket stands for it: a row each but for the least, the hub. key has the table's number in its
    low 12 bits; it is null in buckets of two roots.

    Entries travel as packed arrays, a row a table and batch, and a group of them (a table, or a part of its keys) is
    sorted at once. A root is sent for the linked nodes only, which come last."""

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not len(batch):
                continue
            ids, keys, roots = batch.column(0).to_numpy(), table_keys(_sigs(batch.column(1)), tables, bits, first, last), batch.column(2).to_numpy()
            order = np.argsort(ids != roots, kind="stable")
            ids, keys, roots = ids[order], keys[order], roots[order]
            rows = []
            for j, own in enumerate(np.ascontiguousarray(keys.T)):
                for part in range(parts):
                    here = own % parts == part
                    rows.append((first + j, part, own[here].tobytes(), ids[here].tobytes(), roots[here & (ids != roots)].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["t", "part", "keys", "fps", "roots"])

    def grouped(group: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint32)
        fps = np.frombuffer(b"".join(group.column("fps").to_pylist()), np.int64)
        roots = np.frombuffer(b"".join(f[: len(f) - len(r)] + r for f, r in zip(group.column("fps").to_pylist(), group.column("roots").to_pylist(), strict=True)), np.int64)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        order = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
        order = order[np.lexsort((fps[order], roots[order], keys[order]))]
        for least in (True, False):  # the least node of each root; then by node, so a bucket's least comes first
            keys, fps, roots = keys[order], fps[order], roots[order]
            order = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (roots[1:] != roots[:-1])][: len(keys)]) if least else np.lexsort((fps, keys))
        keys, fps = keys[order], fps[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        sizes = np.diff(np.r_[starts, len(keys)])
        hubs, n = np.repeat(fps[starts], sizes), np.repeat(sizes, sizes)
        own = np.setdiff1d(np.arange(len(keys)), starts, assume_unique=True)
        key = pa.array(keys[own].astype(np.int64) << 12 | group.column("t")[0].as_py(), mask=n[own] == 2)
        return pa.table([key, pa.array(fps[own]), pa.array(hubs[own])], names=["key", "fp", "hub"])

    entries = reps.select("fp", "sig", "root").mapInArrow(packed, "t int, part int, keys binary, fps binary, roots binary")
    return checkpointed(entries.groupBy("t", "part").applyInArrow(grouped, "key long, fp long, hub long"))


def met(reps: DataFrame, tables: int, bits: int, first: int, last: int, n: int) -> DataFrame:
    """met_in_tables() of n nodes, in passes."""
    step = last - first if 12 * n * (last - first) <= PASS_BYTES else -(-tables // PASSES)
    parts = -(-n // GROUP_ROWS) or 1
    return reduce(DataFrame.union, [met_in_tables(reps, tables, bits, k, min(k + step, last), parts) for k in range(first, last, step)])


def alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose fingerprints differ in MOST bits at most."""
    own = pairs.distinct().join(reps.select(F.col("fp").alias("b"), F.col("sig").alias("sb")), "b")
    own = own.join(reps.select(F.col("fp").alias("a"), F.col("sig").alias("sa")), "a")
    return own.where(f"{APART} <= {MOST}").select("a", "b")


def heads(roots: DataFrame, near: DataFrame) -> DataFrame:
    """(root, head, size) of the components: the node of most links, which is near its middle."""
    ends = near.select(F.col("a").alias("node")).union(near.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    return roots.join(ends, "node").groupBy("root").agg(F.max(F.struct("links", "node"))["node"].alias("head"), F.count(F.lit(1)).alias("size"))


def reaching(asked: DataFrame, roots: DataFrame, near: DataFrame, reps: DataFrame) -> DataFrame:
    """(root, size, reach, sig) of the asked roots (root): the head's fingerprint, and the most bits to a node of its component."""
    sig = lambda node, name: reps.select(F.col("fp").alias(node), F.col("sig").alias(name))
    head = heads(roots, near)
    reach = roots.join(head, "root").join(sig("head", "sa"), "head").join(sig("node", "sb"), "node").groupBy("root").agg(F.max(F.expr(APART)).alias("reach"))
    known = asked.join(head.join(reach, "root"), "root", "left")
    known = known.select("root", F.coalesce("head", "root").alias("head"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("reach", F.lit(0)).alias("reach"))
    return checkpointed(known.join(sig("head", "sig"), "head").drop("head"))


def within(sigs: np.ndarray, one: np.ndarray, most: np.ndarray | int = MOST) -> np.ndarray:
    """Which of the fingerprints differ from one in `most` bits at most."""
    return np.flatnonzero(np.bitwise_count(sigs ^ one).sum(1, dtype=np.int64) <= most)


def suspects(rows: DataFrame, roots: DataFrame, near: DataFrame, reps: DataFrame) -> DataFrame:
    """(r, sr, o, so): pairs of different roots, and their sizes, that met in rows of met() and may have a link. By the
    triangle inequality none has one whose heads differ in more bits than MOST and both reaches."""
    of = lambda node, name: roots.select(F.col("node").alias(node), F.col("root").alias(name))
    own = rows.distinct().join(of("fp", "rf"), "fp", "left").join(of("hub", "rh"), "hub", "left")
    own = checkpointed(own.select("key", F.coalesce("rf", "fp").alias("rf"), F.coalesce("rh", "hub").alias("rh")))
    pairs = own.where("rf <> rh").select(F.least("rf", "rh").alias("r"), F.greatest("rf", "rh").alias("o")).distinct()
    more = own.where("key is not null").select("key", F.col("rf").alias("fp")).union(own.where("key is not null").select("key", "rh")).distinct()
    more = more.join(more.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("key"), "key")
    known = reaching(pairs.select(F.col("r").alias("root")).union(pairs.select("o")).union(more.select("fp")).distinct(), roots, near, reps)
    side = lambda r, a: known.select(F.col("root").alias(r), F.col("size").alias(f"s{r}"), F.col("reach").alias(f"reach_{r}"), F.col("sig").alias(a))
    two = pairs.join(side("o", "sb"), "o").join(side("r", "sa"), "r").where(f"{APART} <= {MOST} + reach_r + reach_o").select("r", "sr", "o", "so")
    more = dealt(more, known.select(F.col("root").alias("fp"), F.lit(800).alias("weight"))).join(known.withColumnRenamed("root", "fp"), "fp")
    groups = more.groupBy("key", "s0", "s1").agg(F.collect_list(F.struct("fp", "size", "reach", "sig", "side")).alias("rows"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s0, s1, one in zip(*batch.columns, strict=True):
                ids, size, reach, sigs, side = one.values.flatten()
                ids, size, reach, sigs, side = ids.to_numpy(), size.to_numpy(), reach.to_numpy(), _sigs(sigs), side.to_numpy()
                for i in range(len(ids) - 1):
                    j = i + 1 + within(sigs[i + 1 :], sigs[i], MOST + reach[i] + reach[i + 1 :])
                    j = j if s0.as_py() == s1.as_py() else j[side[j] != side[i]]
                    if len(j):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), ids[i])), pa.array(np.full(len(j), size[i])), pa.array(ids[j]), pa.array(size[j])], names=["r", "sr", "o", "so"])

    return two.union(groups.select("s0", "s1", "rows").mapInArrow(batches, "r long, sr long, o long, so long")).distinct()


def links_between(pairs: DataFrame, roots: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): links within MOST bits between the components of pairs of suspects(): each node of the lesser one with one
    of the other, if there is one. Up to GROUP_BYTES a group holds all of both, beyond that parts of each."""
    first = F.expr("sr > so or (sr = so and r < o)")
    pairs = pairs.select(F.when(first, F.col("r")).otherwise(F.col("o")).alias("to"), F.when(first, F.col("o")).otherwise(F.col("r")).alias("root"))
    nodes = lambda df: df.join(roots, "root", "left").select("to", F.coalesce("node", "root").alias("fp")).distinct()
    both = nodes(pairs).withColumn("here", F.lit(False)).union(nodes(pairs.select("to", F.col("to").alias("root")).distinct()).withColumn("here", F.lit(True)))
    both = checkpointed(both)
    count = lambda here: F.ceil(F.sum(F.when(F.col("here") == here, 800).otherwise(0)) / GROUP_BYTES)
    both = both.join(both.groupBy("to").agg(count(True).alias("k1"), count(False).alias("k0")), "to")
    all_of = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
    own = lambda k: F.array(F.pmod(F.xxhash64("fp"), k))
    both = both.withColumn("p1", F.explode(F.when(F.col("here"), own("k1")).otherwise(all_of("k1")))).withColumn("p0", F.explode(F.when(F.col("here"), all_of("k0")).otherwise(own("k0"))))
    groups = both.join(reps.select("fp", "sig"), "fp").groupBy("to", "p0", "p1").agg(F.collect_list(F.struct("fp", "here", "sig")).alias("rows"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for one in batch.column(0):
                ids, here, sigs = one.values.flatten()
                ids, here, sigs = ids.to_numpy(), here.to_numpy(zero_copy_only=False), _sigs(sigs)
                theirs, there = ids[here], sigs[here]
                found = [(a, theirs[at[0]]) for a, x in zip(ids[~here], sigs[~here], strict=True) if len(at := within(there, x))]
                if found:
                    at = np.array(found, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(at.min(1)), pa.array(at.max(1))], names=["a", "b"])

    return groups.select("rows").mapInArrow(batches, "a long, b long").distinct()


def neighbourhoods(reps: DataFrame, n: int) -> DataFrame:
    """(node, root): the components of the links within MOST bits between the n nodes reps (fp, sig) that meet in a table;
    nodes without one are left out.

    A first few tables join most. In all others only buckets of several roots count, by a node each, which is compared
    with the hub; what that leaves is told by suspects() and compared node by node. So rows go with the nodes, however
    many of a group meet."""
    tables, bits = tables_for(n)
    star = lambda rows: rows.select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    rows = met(reps.select("fp", "sig", F.col("fp").alias("root")), tables, bits, 0, FIRST, n)
    near = checkpointed(alike(star(rows), reps))
    roots = checkpointed(components(near))
    own = joined(reps.select("fp", "sig"), roots, [("fp", "node")]).select("fp", "sig", F.coalesce("root", "fp").alias("root"))
    more = met(own, tables, bits, FIRST, tables, n)
    near, rows = near.union(checkpointed(alike(star(more), reps))), rows.union(more)
    roots = checkpointed(components(near))
    left = checkpointed(suspects(rows, roots, near, reps))
    if left.isEmpty():
        return roots
    return checkpointed(components(near.union(checkpointed(links_between(left, roots, reps)))))


def sets_of(nodes: DataFrame, reps: DataFrame, texts: DataFrame, size: int = WIDE_SHINGLE) -> DataFrame:
    """(fp, set): the shingle hashes of the nodes (fp); only their texts are read again."""
    asked = checkpointed(reps.join(nodes.distinct(), "fp").select("fp", F.col("row.__id").alias("ri"), F.col("row.__h").alias("rh")))
    own = joined(texts, asked, [("__id", "ri"), ("__h", "rh")], "inner").select("fp", "__text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = [shingle_hashes(t.as_py(), size).view(np.int64) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "set"])

    return checkpointed(own.mapInArrow(batches, "fp long, set array<long>").dropDuplicates(["fp"]))


def spanning(sigs: np.ndarray, sets: list[np.ndarray], across: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of SIMILARITY that span all such links of the rows (fingerprint, sorted set) within MOST bits; with `across` (a
    side of each row), of those between different sides. The sets are read in whole numbers, without an estimate."""
    up, down = SIMILARITY
    sizes, label, out = np.array([len(x) for x in sets]), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if across is not None:
            rest = rest[across[rest] != across[i]]
        rest = rest[(up * sizes[rest] <= down * sizes[i]) & (up * sizes[i] <= down * sizes[rest])]
        rest = rest[within(sigs[rest], sigs[i])]
        for k in range(0, len(rest), 256):
            some = rest[k : k + 256]
            theirs = np.concatenate([sets[j] for j in some])
            at = np.minimum(np.searchsorted(sets[i], theirs), sizes[i] - 1)
            shared = np.add.reduceat(sets[i][at] == theirs, np.r_[0, np.cumsum(sizes[some])[:-1]], dtype=np.int64)
            some = some[(up + down) * shared >= up * (sizes[i] + sizes[some])]
            some = some[label[some] != label[i]]
            some = some[np.unique(label[some], return_index=True)[1]]
            out += [(i, int(j)) for j in some]
            label[np.isin(label, label[some])] = label[i]
    return out


def dealt(own: DataFrame, weights: DataFrame) -> DataFrame:
    """own (key, fp) by groups (key, s0, s1), with the side of each row. The rows of a key are one group up to GROUP_BYTES of
    the weights (fp, weight) and SIDE rows; beyond, they are dealt into sides and every two sides are a group."""
    most = F.ceil(F.greatest(F.sum("weight") / GROUP_BYTES, F.count(F.lit(1)) / SIDE))
    own = own.join(own.join(weights, "fp").groupBy("key").agg(most.alias("k")), "key").withColumn("side", F.pmod(F.xxhash64("fp"), "k"))
    own = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return own.select("key", F.least("side", "o").alias("s0"), F.greatest("side", "o").alias("s1"), "fp", "side")


def exact(roots: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that span those of SIMILARITY between the nodes (node, root) of one root; fewer than the rows of its groups."""
    own = dealt(roots.select(F.col("root").alias("key"), F.col("node").alias("fp")), sets.select("fp", (8 * F.size("set") + 800).alias("weight")))
    own = own.join(sets.join(reps.select("fp", "sig"), "fp"), "fp")
    groups = own.groupBy("key", "s0", "s1").agg(F.collect_list(F.struct("fp", "sig", "set", "side")).alias("rows"))

    def linked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s0, s1, one in zip(*batch.columns, strict=True):
                ids, sigs, own, side = one.values.flatten()
                own = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in own]
                got = spanning(_sigs(sigs), own, None if s0.as_py() == s1.as_py() else side.to_numpy())
                if got:
                    at = ids.to_numpy()[np.array(got)]
                    yield pa.RecordBatch.from_arrays([pa.array(at.min(1)), pa.array(at.max(1))], names=["a", "b"])

    return groups.select("s0", "s1", "rows").mapInArrow(linked, "a long, b long").distinct()


def near_copies(rows: DataFrame, texts: DataFrame, size: int = WIDE_SHINGLE) -> tuple[DataFrame, DataFrame]:
    """As classes(), for rows of wide_rows of texts (__id, __h, __text): (fp, id, n), and (fp, component_id) of the linked ones.

    Nodes that can be linked are of one neighbourhood. Inside each, all pairs within MOST bits are compared by their
    exact shingle sets, and only links that span its components leave."""
    with tidy(rows.sparkSession):
        least = (F.min("__id").alias("id"), F.min(F.struct("__id", "__h")).alias("row"))
        reps = checkpointed(rows.groupBy("fp").agg(*least, F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig")))
        near = neighbourhoods(reps, reps.count())
        sets = sets_of(near.select(F.col("node").alias("fp")), reps, texts, size)
        roots = components(checkpointed(exact(near, reps, sets)))
        dropped(sets)
        roots = checkpointed(roots.join(reps.select("fp", "id"), F.col("node") == F.col("fp")).select("fp", "id", "root"))
        least = roots.groupBy("root").agg(F.min("id").alias("component_id"))
        return reps.select("fp", "id", "n"), roots.join(least, "root").select("fp", "component_id")


def classes(rows: DataFrame, doc_id: str = "doc_id", distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(fp, id, n) of every fingerprint with its smallest id and row count, and (fp, component_id) of every linked one."""
    reps = checkpointed(rows.groupBy("fp").agg(F.min(doc_id).alias("id"), F.count(F.lit(1)).alias("n")))
    roots = components(links(reps.select("fp"), distance))
    roots = checkpointed(roots.join(reps.select("fp", "id"), F.col("node") == F.col("fp")).select("fp", "id", "root"))
    least = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    return reps, roots.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id."""
    own = checkpointed(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text")), "__text", size))
    reps, linked = classes(own, "doc_id", distance)
    got = reps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "id").alias("component_id"))
    return joined(own, checkpointed(got), [("fp", "fp")])


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE, wide: bool = False) -> DataFrame:
    """docs with one row of each component: the one with the smallest id (repeated rows of it: the first by text hash).

    Components are those of near_duplicates(), or with wide=True those of near_copies(), which has no distance.
    Only ids, fingerprints and hashes are grouped. The rows to drop are joined to the texts by (id, text hash); up to
    a checked number they are broadcast and the texts do not move."""
    key = lambda df: (col(doc_id).alias("__id"), F.xxhash64(F.coalesce(col(text).cast("string"), F.lit(""))).alias("__h"))
    own = docs.select(*key(docs), col(text).cast("string").alias("__text"))
    texts = own
    own = checkpointed(wide_rows(own, "__text", size) if wide else fingerprints(own, "__text", size))
    reps, linked = near_copies(own, texts, size) if wide else classes(own, "__id", distance)
    cls = checkpointed(reps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "id").alias("c"), F.coalesce("n", F.lit(0)).alias("n")))
    ids = own.groupBy("fp", "__id", "__h").agg(F.count(F.lit(1)).alias("k"))
    ids = joined(ids, cls.select("fp", "c"), [("fp", "fp")])
    first = ids.groupBy("c").agg(F.min(F.struct(F.expr("__id is null"), "__id", "__h")).alias("f"), F.sum("k").alias("rows")).select("c", F.col("f.__id").alias("fi"), F.col("f.__h").alias("fh"), "rows").where("rows > 1")
    judged = checkpointed(ids.alias("i").join(first, F.col("i.c").eqNullSafe(first["c"])).select("__id", "__h", "k", F.expr("__id <=> fi and __h = fh").alias("stays")))
    drop = judged.where("not stays").select("__id", "__h").distinct()
    again = judged.where("stays and k > 1").select("__id", "__h").distinct()
    rows = docs.select(F.struct(*map(col, docs.columns)).alias("__row"), *key(docs))
    kept = joined(rows, checkpointed(drop).withColumn("__gone", F.lit(True)), [("__id", "__id"), ("__h", "__h")]).where("__gone is null").drop("__gone")
    again = checkpointed(again)
    if not again.isEmpty():
        marked = joined(kept, again.withColumn("__more", F.lit(True)), [("__id", "__id"), ("__h", "__h")])
        once = marked.where("__more").groupBy("__id", "__h").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
        kept = marked.where("__more is null").select("__row").union(once.select("__row"))
    return kept.select(*[F.col(f"__row.{quoted(c)}").alias(c) for c in docs.columns])


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
