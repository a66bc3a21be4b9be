import random

import pytest

from rasterweave.llm import licences as q

from .conftest import SCHEMA, prose, row


@pytest.fixture(scope="module")
def model():
    return q.fitted([prose(i, 12) for i in range(300)])


def test_held_out_accuracy(model):
    """Variants from another seed than the training's."""
    rng = random.Random(99)
    rows = [(v, f) for f, ts in q.TEMPLATES.items() for t in ts for v in q.variants(t, 6, rng, parts=False)]
    got = model.families([q.words(v) for v, _ in rows])
    right = sum(g == f for g, (_, f) in zip(got, rows, strict=True))
    wrong = sum(g not in (f, "unknown") for g, (_, f) in zip(got, rows, strict=True))
    assert right >= 0.93 * len(rows) and wrong <= 0.02 * len(rows)
    others = [v for t in q.OTHERS for v in (t, t.upper(), f"{t} {prose(len(t), 9)}")] + [prose(1000 + i, 15) for i in range(200)]
    assert sum(g in q.TEMPLATES for g in model.families([q.words(v) for v in others])) <= 1


def test_held_out_templates():
    """Templates that the training has not seen are seldom called another family's, as the first fit's threshold promises."""
    kept = {f: [t for i, t in enumerate(ts) if i % 4 != 3] for f, ts in q.TEMPLATES.items()}
    got = q.fitted([prose(i, 12) for i in range(300)], kept)
    got.templates = {f: [q.trigrams(q.words(t)) for t in ts] for f, ts in q.TEMPLATES.items()}
    rows = [(t, f) for f, ts in q.TEMPLATES.items() for i, t in enumerate(ts) if i % 4 == 3]
    said = got.families([q.words(t) for t, _ in rows])
    assert sum(s not in (f, "unknown", "none") for s, (_, f) in zip(said, rows, strict=True)) == 0
    assert sum(s != "none" for s in said) >= 0.6 * len(rows)


def test_unknown_and_template(model):
    got = model.families([q.words(x) for x in ("Licensed under the Foo Bar License 9.", "RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!", "", "zzz")])
    assert got == ["unknown", "mit", "none", "none"]


def test_licences_without_templates(model):
    """Whole families that no row of the training holds are licences, but unknown."""
    boost = ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"]
    isc = ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]
    assert model.families([q.words(x) for x in boost + isc]) == ["unknown"] * 3


def test_the_classifier_decides(model):
    """Rows in which a template's 3-grams stand, so that the comparison alone would call them licences."""
    rows = ["All rights reserved for the farmers are listed in the deed.", "She asked whether all rights reserved to the crown were lost.", "Are all rights reserved by the states?"]
    own = [q.words(x) for x in rows]
    assert all(any(model.confirmed(f, w) for f in q.TEMPLATES) for w in own)
    assert not set(model.families(own)) & set(q.TEMPLATES)
    assert model.families([q.words("All rights reserved."), q.words("Copyright 2019 Example Corp. All rights reserved.")]) == ["all-rights-reserved"] * 2


def test_full_texts(spark, model):
    """A wrapped MIT text, line by line, and a BSD clause."""
    import textwrap

    for family, at in (("mit", slice(0, 3)), ("bsd-3-clause", slice(0, 3))):
        text = "\n\n".join("\n".join(textwrap.wrap(t, 70)) for t in q.TEMPLATES[family][at])
        one = q.scanned(spark.createDataFrame([row(1, text)], SCHEMA), model=model).first()
        assert family in {x.family for x in one.licences}
    half = q.TEMPLATES["mit"][0].split(" to deal in ")[1]
    assert model.scores([q.words(half)])[0].argmax() == model.classes.index("mit")


def test_scan(spark, docs, none, rows, model):
    got = q.scanned(docs, model=model).collect()
    assert len(got) == len(rows) and not any(r.licences for r in got)
    text = prose(1, 50) + "\n\nAll rights reserved.\n" + prose(2, 3000) + "\nLicensed under CC BY-NC 4.0."
    one = q.scanned(spark.createDataFrame([row(1, text)], SCHEMA), model=model).first()
    assert [(x.paragraph, x.family) for x in one.licences] == [(2, "all-rights-reserved"), (4, "cc-by-nc-4.0")] and one.n_paragraphs == 4
    assert q.scanned(none).count() == 0


def test_wrapped_notices(spark, model):
    gpl = "You can redistribute it and/or modify\nit under the terms of the GNU General\nPublic License version 3."
    cc = "This work is licensed under a\nCreative Commons Attribution-ShareAlike\n4.0 International License."
    text = prose(1, 30) + "\n\n" + gpl + "\n\n" + "\n".join(prose(20 + i, 9) for i in range(30)) + "\n" + cc + "\n" + "\n".join(prose(60 + i, 9) for i in range(30))
    one = q.scanned(spark.createDataFrame([row(1, text)], SCHEMA), model=model).first()
    assert {x.family for x in one.licences} - {"unknown"} == {"gpl-3.0", "cc-by-sa-4.0"}
