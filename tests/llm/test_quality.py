import re
from collections import Counter

from rasterweave.llm import quality

from .conftest import SCHEMA, prose, row


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_counts(spark, docs, rows):
    own = [*rows, row(1, "a b c d e f g h " * 3 + "x"), row(2, "# a\n# a\n\n|<>\n# a"), row(3, "p q r s t u v w z p q r s t u v w")]
    got = quality.verdicts(spark.createDataFrame(own, SCHEMA), keep_columns=["doc_id", "text"]).collect()
    assert len(got) == len(own)
    for r in got:
        n = brute(r.text)
        assert (r["__n_words"], r["__word_chars"], r["__n_symbols"], r["__n_dup_lines"], r["__n_repeat_words"]) == n
        assert r["__base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r["__base_failed"] and r["__kept"])


def test_fences_follow_the_group(spark):
    """Symbols that are usual in a source are kept there and rejected elsewhere."""
    code = [row(i, prose(i, 60).replace(" ", " # "), "en", "code") for i in range(60)]
    text = [row(100 + i, prose(200 + i, 60), "en", "text") for i in range(60)] + [row(999, prose(5, 60).replace(" ", " # "), "en", "text")]
    got = {r.doc_id: r["__kept"] for r in quality.verdicts(spark.createDataFrame(code + text, SCHEMA)).collect()}
    assert not got.pop(999)
    assert all(got.values())


def test_no_rate_has_a_fixed_cutoff(spark):
    """Two sources that differ in every rate have different fences for every rate."""
    line = lambda i, w: f"{w} {prose(i, 11)}"
    plain = [row(i, "\n".join(line(9 * i + k, "w") for k in range(6)), "en", "plain") for i in range(150)]
    odd = [row(500 + i, "\n".join(line(9000 + 9 * i + k, "SHOUT #1 42") for k in range(6)) + f"\n{prose(7 + i % 5, 9)}" * 2 + " abcdefghijklmnopqrstuvwxyz" * (i % 7), "en", "odd") for i in range(150)]
    got = quality.thresholds(quality._rates(quality.checkpointed(quality.counts(spark.createDataFrame(plain + odd, SCHEMA)))), ("lang", "source")).collect()
    a, b = (next(r for r in got if r.source == s) for s in ("plain", "odd"))
    for m in quality.RULES:
        assert a[f"__hi_{m}"] != b[f"__hi_{m}"], m
    assert a["__own"] == b["__own"] == 93


def test_names_with_dots(spark):
    own = spark.createDataFrame([row(i, prose(i, 60)) for i in range(5)], SCHEMA).withColumnsRenamed({"n": "x.y", "h": "a`b"})
    assert quality.keep(own).columns == own.columns and quality.keep(own).count() == 5


def test_keep_gives_the_same_rows(spark, docs):
    want = quality.verdicts(docs).where("__kept").select(docs.columns)
    got = quality.keep(docs)
    assert got.schema.names == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty(none):
    assert quality.verdicts(none).count() == 0
    assert quality.keep(none).columns == none.columns and quality.keep(none).count() == 0
