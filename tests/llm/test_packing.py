import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterweave.llm import packing, tokens

from .conftest import prose


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 4))
def test_bounds_pad_least(h, k):
    lengths = sorted(h)
    cost = lambda c: sum(next(b for b in c if b >= n) * x for n, x in h.items())
    best = min(cost([*c, lengths[-1]]) for r in range(k) for c in itertools.combinations(lengths[:-1], r))
    got = packing.bounds(h, k)
    assert cost(got) == best and len(got) <= k and got[-1] == lengths[-1]


def test_batches(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 5)
    got = packing.pack(docs, longest=64, budget=512, buckets=4).toPandas()
    encode, _ = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    want = [len(encode(r[1])) if r[1] else 0 for r in rows]
    assert got.n_tokens.sum() == sum(want) and len(got) == sum(max(1, -(-n // 64)) for n in want)
    assert (got.n_tokens <= got.bucket_length).all() and got.bucket_length.nunique() <= 4
    for size, g in got.groupby("bucket_length"):
        n = g.groupby("batch").size().sort_index()
        cap = max(1, 512 // max(1, size))
        assert list(n.index) == list(range(len(n))) and (n[:-1] == cap).all() and n.iloc[-1] <= cap
    key = got[got.doc_id.notna()].groupby("doc_id").start_token.max()
    assert key[300] == 64 * ((want[[r[0] for r in rows].index(300)] - 1) // 64)


def test_empty(none):
    assert packing.bounds({}) == []
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("rule", ["first", "most"])
def test_attribution(spark, docs, rows, rule):
    encode, _ = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    got = tokens.attributed(docs, rule=rule).toPandas()
    assert got.n_tokens.sum() == sum(len(encode(r[1])) for r in rows if r[1])
    assert len(got) == sum(max(1, (r[1] or "").count("\n") + (not (r[1] or "").endswith("\n"))) for r in rows)


def test_crossing_tokens(spark):
    text = "hello worldé x"
    encode, lengths = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    spans = []
    at = 0
    for t in encode(text):
        spans.append((at, at + lengths[t]))
        at += lengths[t]
    for rule in ("first", "most"):
        for a, b in ((0, 3), (3, 9), (2, 12), (13, 14)):
            df = spark.createDataFrame([(1, text, [(0, a), (a, b)] if a else [(a, b)])], "doc_id int, text string, s array<struct<start:int,stop:int>>")
            got = {r.section: r.n_tokens for r in tokens.attributed(df, sections="s", rule=rule).collect()}
            cuts = [(len(text[:x].encode()), len(text[:y].encode())) for x, y in ([(0, a), (a, b)] if a else [(a, b)])]
            want = {k: 0 for k in range(len(cuts))}
            for s, e in spans:
                share = [max(0, min(e, y) - max(s, x)) for x, y in cuts]
                if rule == "most":
                    k = share.index(max(share)) if max(share) else -1
                else:
                    k = next((i for i, (x, y) in enumerate(cuts) if x <= s < y), -1)
                want[k] = want.get(k, 0) + 1
            assert got == want


def test_attribution_of_none(none):
    assert tokens.attributed(none).count() == 0
    with pytest.raises(ValueError):
        tokens.attributed(none, rule="last")


def test_bytes_that_are_no_text(spark):
    df = spark.sql("select 1L as doc_id, cast(X'61FF62' as string) as text")
    assert packing.pack(df).first().n_tokens > 0
    assert tokens.attributed(df).first().n_tokens > 0


def test_repeated_ids_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 10)
    df = spark.createDataFrame([(None, "same words here")] * 500, "doc_id long, text string")
    got = packing.pack(df, budget=64)
    per = 64 // got.first().bucket_length
    sizes = sorted(r["count"] for r in got.groupBy("batch").count().collect())
    assert sum(sizes) == 500 and set(sizes[1:]) == {per}


def test_tokens_come_out(spark):
    texts = {i: prose(i, 40 * i) for i in range(1, 8)} | {9: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = packing.tokenised(packing.pack(df, longest=50), df, longest=50).collect()
    with open(tokens.VOCABULARY, "rb") as f:
        encode, _ = tokens.encoder(f.read())
    for i, t in texts.items():
        own = sorted((r.segment, r.tokens) for r in got if r.doc_id == i)
        assert [x for _, part in own for x in part] == encode(t) and all(len(part) <= 50 for _, part in own)
    assert all(len(r.tokens) == r.n_tokens for r in got)
