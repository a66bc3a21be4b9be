import re

import pytest

from rasterweave.llm import decontaminate as d

from .conftest import SCHEMA, prose, row


def brute_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w, hit, names = brute_words(text), set(), set()
    for name, t in items:
        b = brute_words(t)
        n = min(13, len(b))
        for i in range(len(b) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit |= set(range(j, j + n))
                    names.add("" if name is None else str(name))
    return len(w), len(hit), sorted(names)


@pytest.fixture(scope="module")
def items(spark):
    own = [(1, prose(50, 30)), (2, prose(51, 13)), (2, prose(52, 20)), (3, "Short Item"), (4, None), (5, ""), (6, "..."), (None, prose(53, 15)), (7, prose(50, 30)), (8, "Éa-b")]
    return own, spark.createDataFrame([(*x, 0) for x in own], "item_id long, text string, __row int")


def test_marked(spark, rows, items):
    own = [r for r in rows if len(r[1] or "") < 20_000]
    own += [row(1, "x " + prose(50, 30).upper() + "! tail"), row(2, prose(51, 12)), row(3, prose(60, 900) + " short  item " + prose(61, 5)), row(4, prose(53, 15) + " " + prose(52, 20)), row(5, "éa b")]
    docs = spark.createDataFrame(own, SCHEMA)
    for limit in (10**6, 200):
        got = d.marked(docs, items[1], limit=limit).collect()
        assert len(got) == len(own)
        for r in got:
            h = r["__hits"]
            assert (h.n_words, sum(x.e - x.s for x in h.spans), h["items"]) == brute(r["__text"], items[0])


def test_removal(spark, items):
    docs = spark.createDataFrame([row(1, "keep this, " + prose(51, 13) + " and this."), row(2, prose(70, 400) + " short item"), row(3, None)], SCHEMA)
    assert {r.doc_id for r in d.decontaminated(docs, items[1]).collect()} == {2, 3}
    cut = {r.doc_id: r for r in d.decontaminated(docs, items[1], remove="spans").collect()}
    assert cut[1].text == "keep this,  and this." and cut[3].text is None and cut[1].source == "a"
    with pytest.raises(ValueError):
        d.decontaminated(docs, items[1], remove="x")


def test_empty(none, docs, items):
    assert d.marked(none, items[1]).count() == 0
    assert d.decontaminated(docs, items[1].limit(0)).count() == docs.count()
    assert d.decontaminated(docs, items[1]).columns == docs.columns


def test_table_is_compact_and_shared(spark):
    import pickle

    text = prose(90, 40_000)
    grams = d.Grams([("a", text.encode()), ("b", text.encode())])
    assert len(pickle.dumps(grams)) < 20 * len(text)
    (n, spans, items), = d.scan([("x " + text).encode()], grams)
    assert (n, spans, items) == (40_001, [(1, 40_001)], {"a", "b"})


def test_names_with_dots(spark, items):
    docs = spark.createDataFrame([row(1, prose(51, 13)), row(2, "fine")], SCHEMA).withColumnRenamed("n", "x.y")
    got = d.decontaminated(docs, items[1])
    assert got.columns == docs.columns and [r.doc_id for r in got.collect()] == [2]
