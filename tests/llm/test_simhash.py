import random
import re
import time

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterweave.llm import simhash
from rasterweave.llm.components import components

from .conftest import SCHEMA, prose, row


def brute_fp(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(values):
    part = {v: v for v in values}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    vs = sorted(part)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if (a ^ b).bit_count() <= 3:
                p, q = sorted((find(a), find(b)))
                part[q] = p
    return {v: find(v) for v in vs}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB \t\né\x0b\x85", max_size=60))
def test_fingerprint(t):
    assert simhash.fingerprint(t.encode()) == brute_fp(t)


def test_near_duplicates(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    cls = brute_classes({brute_fp(r[1]) for r in rows})
    least = {}
    for r in rows:
        if r[0] is not None:
            c = cls[brute_fp(r[1])]
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted(str((r[0], brute_fp(r[1]), least.get(cls[brute_fp(r[1])]))) for r in rows)
    assert sorted(str((r.doc_id, r.fp % 2**64, r.component_id)) for r in got) == want


def clustered(seed, n=300):
    r, out = random.Random(seed), []
    centres = [r.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    for _ in range(n):
        v = r.choice(centres)
        for b in r.sample(range(64), r.randint(0, 6)):
            v ^= 1 << b
        out.append(v)
    return out


def test_links_span_all_classes(spark, monkeypatch):
    for seed, bucket in ((1, 4096), (2, 3)):  # small buckets: the second level
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        values = clustered(seed)
        fps = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in set(values)], "fp long")
        edges = simhash.links(fps).collect()
        assert all((e.a ^ e.b & -1) % 2**64 != 0 and ((e.a ^ e.b) % 2**64).bit_count() <= 3 for e in edges)
        got = {}
        for r in components(simhash.links(fps)).collect():
            got.setdefault(r.root, set()).add(r.node % 2**64)
        want = {}
        for v, c in brute_classes(set(values)).items():
            want.setdefault(c, set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_components_of_a_long_path_and_loops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(7, 7), (3, 2), (-5, -9)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, -5: -9, -9: -9}
    assert components(edges.limit(0)).count() == 0


def test_deduplicated_keeps_one_of_each(docs, none, rows):
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    classes = brute_classes({brute_fp(r[1]) for r in rows})
    kept = [classes[brute_fp(r.text)] for r in got.collect()]
    assert sorted(kept) == sorted(set(classes.values()))
    assert {r.doc_id for r in got.collect()} >= {100, 200, 300}
    assert simhash.deduplicated(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_near_copies_of_a_similarity_of_08(spark):
    r = random.Random(4)
    base = [prose(100 + i, 250).split() for i in range(12)]
    rows, own = [], {}
    for i, words in enumerate(base):
        for k in range(4):
            copy = list(words)
            for at in r.sample(range(250), 2 * (k > 0)):  # two changed words: a similarity of 0.85 and more with the first
                copy[at] = "zq" + copy[at]
            own[len(rows)] = i
            rows.append(row(len(rows), " ".join(copy)))
    rows += [row(900 + i, None if i < 2 else "") for i in range(4)] + [row(None, " ".join(base[0])), row(950, "a b"), row(951, "a c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = simhash.deduplicated(docs, size=simhash.WIDE_SHINGLE, distance=simhash.WIDE_DISTANCE, wide=True)
    assert got.columns == docs.columns
    assert sorted(x.doc_id for x in got.collect()) == [4 * i for i in range(12)] + [900, 950, 951]
    assert simhash.deduplicated(docs.limit(0), size=5, distance=50, wide=True).count() == 0


def jaccard(a, b, n=5):
    p, q = ({tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for t in (a, b))
    return len(p & q) / len(p | q)


def edited(words, kind, other):
    """A near copy at 0.8 to 0.86: a passage added, cut or replaced, or single words changed."""
    n, out = len(words), list(words)
    if kind == "appended":
        return words + other[: n * 2 // 10]
    if kind == "cut":
        return words[: n - n * 17 // 100]
    if kind == "replaced":
        return words[: n // 2] + other[: n * 8 // 100] + words[n // 2 + n * 8 // 100 :]
    for k in range(n * 16 // 1000):
        out[(2 * k + 1) * n // (2 * (n * 16 // 1000))] = other[k]
    return out


def test_near_copies_whatever_was_edited(spark):
    kinds, rows = ("appended", "cut", "replaced", "scattered"), []
    for i in range(240):
        words, other = prose(3000 + i, 300).split(), prose(9000 + i, 100).split()
        copy = edited(words, kinds[i % 4], other)
        assert 0.8 <= jaccard(words, copy) <= 0.88
        rows += [row(2 * i, " ".join(words)), row(2 * i + 1, " ".join(copy))]
    got = simhash.deduplicated(spark.createDataFrame(rows, SCHEMA), size=simhash.WIDE_SHINGLE, wide=True)
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 480, 2))


def test_texts_below_08_stay(spark):
    rows = []
    for i in range(60):
        words, other = prose(5000 + i, 300).split(), prose(7000 + i, 100).split()
        copy = words + other[: 80 + i % 10] if i % 2 else edited(edited(words, "scattered", other), "scattered", other[::-1])
        if not i % 2:
            copy = copy[: 255 + i % 10]
        assert 0.65 <= jaccard(words, copy) < 0.8
        rows += [row(2 * i, " ".join(words)), row(2 * i + 1, " ".join(copy))]
    five = prose(1, 104).split()  # 100 shingles; 25 more give 0.8, 26 more less
    rows += [row(500, " ".join(five)), row(501, " ".join(five + prose(2, 25).split())), row(502, " ".join(prose(3, 26).split() + five))]
    got = simhash.deduplicated(spark.createDataFrame(rows, SCHEMA), size=simhash.WIDE_SHINGLE, wide=True)
    assert sorted(r.doc_id for r in got.collect()) == [*range(120), 500, 502]


def test_names_with_dots(spark):
    docs = spark.createDataFrame([row(1, prose(1, 50)), row(2, prose(1, 50))], SCHEMA).withColumnRenamed("n", "x.y")
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns and [r.doc_id for r in got.collect()] == [1]


@pytest.mark.parametrize("limit", [10**9, 4_000])
def test_near_copies_against_all_pairs(spark, monkeypatch, limit):
    """Copies that are alike to their origin but not to each other, chains, and texts a little below 0.8."""
    monkeypatch.setattr(simhash, "GROUP_BYTES", limit)
    r, texts = random.Random(6), []
    for i in range(5):
        words = prose(11_000 + i, 200).split()
        for _ in range(14):
            copy, share = list(words), r.choice([3, 4, 5, 6])
            for at in r.sample(range(200), share):
                copy[at] = "zq" + prose(r.randrange(10**6), 1)
            texts.append(copy)
        for _ in range(6):  # a chain of appended passages
            texts.append([*texts[-1][20:], *prose(r.randrange(10**6), 14).split()])
    r.shuffle(texts)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = simhash.deduplicated(spark.createDataFrame([row(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA), size=simhash.WIDE_SHINGLE, wide=True)
    assert sorted(x.doc_id for x in got.collect()) == sorted(set(root))
    assert 5 <= len(set(root)) < len(texts)


def test_wide_fingerprints_and_their_tables():
    """The wide fingerprint is a SimHash: a majority bit by bit; pairs at 0.8 differ in 15 of 100 bits and meet in some table."""
    r = np.random.Generator(np.random.PCG64(5))
    for n in (0, 1, 2, 7, 300, 600):
        h = np.unique(r.integers(0, 2**64, n, np.uint64))
        x = (h[:, None] ^ simhash.MIX[0]) * simhash.MIX[1]
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        want = [[2 * sum(int(v) >> b & 1 for v in x[:, w]) > n for b in range(64)] for w in range(0, 32, 31)]
        got = simhash.wide_fingerprint(h).view(np.uint64)
        assert [[int(got[w]) >> b & 1 for b in range(64)] for w in range(0, 32, 31)] == want
    for nodes in (1000, 300_000):
        missed, apart = 0, []
        for _ in range(300):
            h = r.integers(0, 2**64, 220, np.uint64)
            two = np.stack([simhash.wide_fingerprint(np.unique(x)) for x in (h[:200], h[20:])])  # 180 of 220: 0.82
            keys = simhash.table_keys(two, *simhash.tables_for(nodes))
            missed += not (keys[0] == keys[1]).any()
            apart.append(int(np.bitwise_count((two[0] ^ two[1]).view(np.uint64)).sum()))
        assert missed == 0 and max(apart) <= simhash.MOST and 270 < np.mean(apart) < 315


def test_shuffle_files_go_with_their_steps(spark):
    from rasterweave.llm.common import checkpointed, tidy

    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in store.getAllFiles().mkString("\n", "\n", "").split("\n") if "shuffle_" in n}
    with tidy(spark):
        was = files()
        assert checkpointed(spark.range(1000).repartition(7, "id").groupBy("id").count()).count() == 1000
        deadline = time.time() + 20  # files go a little later
        while (left := [n for n in files() - was if n.rsplit(".", 1)[-1] == "data"]) and time.time() < deadline:
            time.sleep(0.2)
        assert len(left) <= 1  # count()'s own
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_pairs_go_with_the_nodes_of_a_group(spark, monkeypatch):
    """A large group of near copies that are hardly alike to each other: pairs go with the first tables, not with all."""
    r, words, pairs, alike = random.Random(8), prose(77, 120).split(), [], simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda p, reps: (pairs.append(p.distinct().count()), alike(p, reps))[1])
    texts = [words]
    for i in range(600):
        copy = list(words)
        for at in r.sample(range(120), 2):
            copy[at] = f"q{i}x{at}"
        texts.append(copy)
    got = simhash.deduplicated(spark.createDataFrame([row(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA), size=simhash.WIDE_SHINGLE, wide=True)
    assert [x.doc_id for x in got.collect()] == [0]
    assert sum(pairs) <= 30 * len(texts), sum(pairs)
