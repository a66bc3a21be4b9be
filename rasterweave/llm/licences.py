"""Licence scans: a paragraph classifier over sparse word n-grams, confirmed by template comparison.

Multinomial logistic regression tells licence families, other licences and "none" apart. Its features are the presence
of word 1- to 3-grams that occur in licence or hand-written rows. It is trained on the driver from labelled rows: the templates below
and notices of families without templates, with rule-made variants, hand-written rows that only sound like licences, and
a bounded sample of the corpus (SAMPLE paragraphs, the least by hash; those that hold a template are left out). A first
fit leaves out every third template of a family, every third of the other families as a whole and a third of the rest;
on those rows the temperature that calibrates the probabilities is found, and each family's threshold to the unknown
class: the probability down to which its predictions are right in TRUST of the cases. The model is then fitted to all
rows. A paragraph is

* none, if "none" is the likeliest class;
* its family, if that is likely enough and CONFIRM of a template's 3-grams occur in the paragraph;
* unknown, if another licence is likeliest, or a family that is not likely enough or that no template confirms.

Every paragraph (line) of every whole text is scored, and so are stretches of consecutive lines, in which hard-wrapped
notices stand: a family that none of a stretch's lines has is told at the first line of the stretch. The model is a few
thousand features and is sent to the executors.

Defined results: null and empty texts have no paragraphs and no licences; a paragraph without known words is none;
equal probabilities go to the first family by name; repeated rows each get their row; an empty table gives an empty
result (the classifier then trains without a sample); other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE, TRUST, CONFIRM = 2000, 0.99, 0.6
NONE, OTHER = "none", "other"
VARIANTS, EPOCHS, SEED = 24, 26, 11
GRAMS = 3
#: Lines of the stretches in which hard-wrapped notices are looked for, besides single lines and whole runs.
WRAPPED = (4, 8)
#: Well-known licence notices by family.
TEMPLATES = {
    "all-rights-reserved": ["All rights reserved.", "All rights reserved worldwide.", "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Released under the Apache License 2.0.", "You may not use this file except in compliance with the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "This project is licensed under the terms of the Apache 2.0 license.",
    ],
    "bsd-3-clause": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.", "Licensed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GPL v2.", "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "gpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU General Public License version 3.", "Licensed under the GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the LGPL v2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ],
}
#: Notices of families that have no templates, so that a licence is told from none without being known.
OTHER_LICENCES = {
    "epl": ["This program is made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "artistic": ["This is free software, licensed under the Artistic License 2.0.", "You may distribute this package under the same terms as Perl itself."],
    "cddl": ["The contents of this file are subject to the terms of the Common Development and Distribution License.", "SPDX-License-Identifier: CDDL-1.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "eupl": ["Licensed under the European Union Public Licence, version 1.2.", "Licensed under the EUPL."],
    "wtfpl": ["Released under the Do What The Fuck You Want To Public License, Version 2.", "Licensed under the WTFPL."],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Released under the zlib License."],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1"],
    "psf": ["Licensed under the Python Software Foundation License Version 2.", "Distributed under the PSF license."],
    "odbl": ["This database is made available under the Open Database License.", "Data licensed under the ODbL 1.0."],
    "house": ["Distributed under the terms of the Example Software License, Version 1.0.", "Use of this software is governed by the license agreement in the file LICENSE.", "Licensed under the terms of the custom license of this project."],
}
#: Rows that are no licences of the text.
OTHERS = [
    "The driver lost his license after the second offence.", "Researchers at MIT released a new study of sleep.", "The Apache helicopter was released from service.", "Version 2.0 of the software was released in May.",
    "A public library is open under the general rules of the city.", "The permission of the teacher is granted.", "All the rights and duties of a citizen are reserved to adults.", "The terms of the agreement are subject to change.",
    "Seats may be reserved by phone.", "You can use this form to apply for a fishing license.", "The work of the author is open to any person.", "This is the file.", "The following conditions were met by the binary star.", "A copy of the documentation is free of charge.",
    "The GNU is an antelope of the open plain.", "Under the law of the land, the source of the river is public.", "The attribution of the painting is not certain.", "The software and the files are in the house.", "Creative work is common in this school.", "The international version is out in March.",
    "All rights reserved for the tenants are listed in the deed.", "Are all rights reserved to the states?", "In the treaty all rights reserved by the king were given up.", "Not all rights reserved in a contract can be sold.", "The talk compares what people mean when they say that code is licensed under the MIT license.", "Students at MIT drive without a license.",
    "The board licensed the shop under the new version of the act.", "A license is needed for the software of the public radio.", "The Mozilla office and the Apache office are in the same street.", "She wrote a history of the general public.",
]
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256))


def words(text: str | bytes) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text
    return raw.translate(_KEEP).split()


def grams(w: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(w[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(w) - n + 1)}


def variants(text: str, n: int, rng: random.Random, parts: bool = True) -> list[str]:
    """The text as it stands and with rule-made surroundings, lost words, other case, and parts of long ones."""
    before = ["", "Copyright 2021 the authors.", "This file is part of the project.", "Notice:", "(c) 2019 Example Corp.", "The code here is"]
    after = ["", "See the file for details.", "http://example.org/licenses", "Contact us for more."]
    out = [text]
    for _ in range(n - 1):
        w = text.split()
        if parts and len(w) > 16 and rng.random() < 0.5:  # a part, as wrapped lines have
            at = rng.randrange(len(w) - 10)
            w = w[at : at + rng.randrange(10, len(w) - at + 1)]
        if len(w) > 6 and rng.random() < 0.4:
            del w[rng.randrange(len(w))]
        one = " ".join([rng.choice(before), *w, rng.choice(after)]).strip()
        out.append(one.upper() if rng.random() < 0.15 else one.replace("license", "licence") if rng.random() < 0.2 else one)
    return out


@dataclass
class Model:
    classes: list[str]
    vocabulary: dict[bytes, int]  # word: code from 1
    codes: np.ndarray  # sorted codes of the grams: base-(words + 1) digits of their words
    weights: np.ndarray  # a row per gram of codes, a column per class
    bias: np.ndarray
    thresholds: np.ndarray  # per class
    templates: dict[str, list[set[tuple[bytes, ...]]]]

    def gram_codes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, row of weights) of every known gram in ids; 0 stands for any other word and between paragraphs."""
        base, at, rows, code = len(self.vocabulary) + 1, [], [], ids
        for n in range(1, GRAMS + 1):
            if n > 1:
                code = np.where((code[:-1] > 0) & (ids[n - 1 :] > 0), code[:-1] * base + ids[n - 1 :], 0)
            k = np.nonzero(code)[0]
            j = np.minimum(np.searchsorted(self.codes, code[k]), len(self.codes) - 1)
            hit = self.codes[j] == code[k]
            at.append(k[hit])
            rows.append(j[hit])
        return np.concatenate(at), np.concatenate(rows)

    def scores(self, paragraphs: list[list[bytes]]) -> np.ndarray:
        """Class probabilities of every paragraph."""
        get = self.vocabulary.get
        ids = np.array([x for p in paragraphs for x in (*[get(w, 0) for w in p], 0)], np.int64)
        owner = np.repeat(np.arange(len(paragraphs)), [len(p) + 1 for p in paragraphs])
        at, rows = self.gram_codes(ids)
        pairs = np.unique(owner[at] * len(self.codes) + rows)  # presence, not counts
        logits = np.tile(self.bias, (len(paragraphs), 1))
        if len(pairs):
            par, row = np.divmod(pairs, len(self.codes))
            starts = np.nonzero(np.diff(par, prepend=-1))[0]
            logits[par[starts]] += np.add.reduceat(self.weights[row], starts)
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def confirmed(self, family: str, paragraph: list[bytes]) -> bool:
        if family not in self.templates:
            return False
        n = {len(g) for t in self.templates[family] for g in t}
        own = {tuple(paragraph[i : i + k]) for k in n for i in range(len(paragraph) - k + 1)}
        return any(len(t & own) >= CONFIRM * len(t) for t in self.templates[family])

    def families(self, paragraphs: list[list[bytes]]) -> list[str]:
        """none, unknown or the family of every paragraph."""
        p = self.scores(paragraphs)
        best = p.argmax(1)
        out = []
        for k, b in enumerate(best):
            name = self.classes[b]
            if name != NONE and not (p[k, b] >= self.thresholds[b] and self.confirmed(name, paragraphs[k])):
                name = "unknown"
            out.append(name)
        return out


def trigrams(w: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(3, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def fitted(sample: list[str], templates: dict[str, list[str]] = TEMPLATES, seed: int = SEED) -> Model:
    """The model, from templates, notices, hand-written rows and at most SAMPLE corpus paragraphs."""
    rng = random.Random(seed)
    shapes = {f: [trigrams(words(t)) for t in ts] for f, ts in templates.items()}
    # (text, class, held out of the first fit): whole templates, whole other families, and rows of none
    rows = [(v, f, i % 3 == 2) for f, ts in sorted(templates.items()) for i, t in enumerate(ts) for v in variants(t, VARIANTS, rng)]
    rows += [(v, OTHER, i % 3 == 2) for i, ts in enumerate(OTHER_LICENCES.values()) for t in ts for v in variants(t, VARIANTS, rng)]
    rows += [(v, NONE, i % 3 == 2) for i, t in enumerate(OTHERS) for v in (t, t.upper(), *[" ".join(rng.sample([t, rng.choice(OTHERS)], 2)) for _ in range(6)])]
    marks = {g for ts in shapes.values() for t in ts for g in t}
    rows += [(t, NONE, i % 3 == 2) for i, t in enumerate(t for t in sample if not trigrams(words(t)) & marks)]
    classes = [*sorted(templates), OTHER, NONE]
    tokens = [(words(t), classes.index(f)) for t, f, _ in rows]
    held = [x for x, (*_, out) in zip(tokens, rows, strict=True) if out]
    first = trained([x for x, (*_, out) in zip(tokens, rows, strict=True) if not out], classes, shapes, seed)
    label = np.array([y for _, y in held])
    logits = np.log(np.maximum(first.scores([w for w, _ in held]), 1e-300))

    def loss(t: float) -> float:
        z = logits / t
        z -= z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(held)), label]).mean())

    heat = min((x / 20 for x in range(4, 101)), key=loss)
    z = logits / heat
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    thresholds = np.zeros(len(classes))
    for c in range(len(templates)):
        right = 0
        for n, k in enumerate(sorted(np.nonzero(best == c)[0], key=lambda k: -p[k, c]), 1):
            right += label[k] == c
            if right < TRUST * n:  # what is at most so likely is not trusted
                thresholds[c] = np.nextafter(p[k, c], 2)
                break
    model = trained(tokens, classes, shapes, seed)
    model.weights, model.bias, model.thresholds = model.weights / heat, model.bias / heat, thresholds
    return model


def trained(rows: list[tuple[list[bytes], int]], classes: list[str], shapes: dict[str, list[set[tuple[bytes, ...]]]], seed: int) -> Model:
    """A model of weights that fit the rows (words, class), not calibrated."""
    rng = random.Random(seed)
    tokens, label = [w for w, _ in rows], np.array([y for _, y in rows])
    known = {g for w, y in rows if classes[y] != NONE for g in grams(w)} | {g for t in OTHERS for g in grams(words(t))}
    vocabulary = {g[0]: i for i, g in enumerate((g for g in sorted(known) if len(g) == 1), 1)}
    base = len(vocabulary) + 1

    def code(g: tuple[bytes, ...]) -> int:
        out = 0
        for w in g:
            out = out * base + vocabulary[w]
        return out

    codes = np.unique(np.array([code(g) for g in known], np.int64))
    model = Model(classes, vocabulary, codes, np.zeros((len(codes), len(classes))), np.zeros(len(classes)), np.ones(len(classes)), shapes)
    rate, power = 0.1, 1e-4
    idx = [np.unique(model.gram_codes(np.array([vocabulary.get(x, 0) for x in w] + [0], np.int64))[1]) for w in tokens]
    train = list(range(len(rows)))
    square, square_bias = np.full(model.weights.shape, 1e-6), np.full(len(classes), 1e-6)
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), 256):
            part = train[at : at + 256]
            flat = np.concatenate([idx[k] for k in part]) if any(len(idx[k]) for k in part) else np.zeros(0, np.int64)
            own = np.repeat(np.arange(len(part)), [len(idx[k]) for k in part])
            z = np.tile(model.bias, (len(part), 1))
            np.add.at(z, own, model.weights[flat])
            e = np.exp(z - z.max(1, keepdims=True))
            d = e / e.sum(1, keepdims=True)
            d[np.arange(len(part)), label[part]] -= 1
            d /= len(part)
            step = power * model.weights
            np.add.at(step, flat, d[own])
            square += step**2
            model.weights -= rate * step / np.sqrt(square)
            square_bias += d.sum(0) ** 2
            model.bias -= rate * d.sum(0) / np.sqrt(square_bias)
    return model


def sampled(docs: DataFrame, text: str, n: int = SAMPLE) -> list[str]:
    """At most n whole lines for training, one of each distinct text, the least by the texts' hash.

    The row count sets the share of the hash range in which about 2 n texts lie, so that tasks pass on a few rows
    whatever the corpus; copies of a text are one row before they meet."""
    total = docs.count()
    top = 2**63 - 1
    share = 1.0 if total <= 2 * n else 2 * n / total
    own = docs.select(F.col(text).cast("string").alias("t")).where("t is not null").withColumn("h", F.xxhash64("t", F.lit(SEED)))
    own = own.where(F.col("h") <= F.lit(min(top, int(-(2**63) + share * 2**64))).cast("long"))
    lines = own.select("h", F.expr("element_at(split(t, '\n'), 1 + cast(pmod(h, size(split(t, '\n'))) as int))").alias("p"))
    lines = lines.distinct().orderBy("h", "p").limit(n).select(F.col("p").cast("binary").alias("p"))
    return [bytes(r.p).decode("utf-8", "replace") for r in lines.collect()]


def stretches(lines: list[tuple[int, list[bytes]]]) -> list[list[tuple[int, list[bytes]]]]:
    """Of every run of consecutive lines (index, words): half overlapping stretches of WRAPPED lines, and the whole run."""
    runs: list[list[tuple[int, list[bytes]]]] = []
    for x in lines:
        if runs and x[0] == runs[-1][-1][0] + 1:
            runs[-1].append(x)
        else:
            runs.append([x])
    runs = [r for r in runs if len(r) > 1]
    return [r[at : at + n] for n in WRAPPED for r in runs if len(r) > n for at in range(0, len(r) - n // 2, n // 2)] + runs


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_paragraphs, licences (array of paragraph, family)."""
    model = model or fitted(sampled(docs, text))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string())]))
    schema = own.select("doc_id", F.lit(None).cast("long").alias("n_paragraphs"), F.lit(None).cast("array<struct<paragraph:int,family:string>>").alias("licences")).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for b in it:
            counts, found, owners, paragraphs, size = [], [[] for _ in range(b.num_rows)], [], [], 0

            def flush() -> None:
                for (k, i, last), family in zip(owners, judge.families(paragraphs), strict=True):
                    if i == last and family != "none" or i < last and family not in ("none", "unknown") and not any(x["family"] == family and i <= x["paragraph"] <= last for x in found[k]):
                        found[k].append({"paragraph": i, "family": family})
                for k in {k for k, _, _ in owners}:
                    found[k].sort(key=lambda x: x["paragraph"])
                owners.clear()
                paragraphs.clear()

            for k, t in enumerate(b.column(1).cast(pa.binary())):
                lines = (t.as_py() or b"").translate(_KEEP).split(b"\n")
                own = [(i, w) for i, line in enumerate(lines) if (w := line.split())]
                # The lines themselves first: what a line holds is not told again for a stretch.
                for part in [[x] for x in own] + stretches(own):
                    owners.append((k, part[0][0], part[-1][0]))
                    paragraphs.append([x for _, w in part for x in w])
                    size += len(paragraphs[-1])
                counts.append(len(own))
                if size > 300_000:
                    flush()
                    size = 0
            if paragraphs:
                flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_paragraphs", "licences"])

    return own.mapInArrow(batches, schema)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scanned(table(spark, sf_dir, "documents"))
    known = F.filter("licences", lambda x: x["family"] != "unknown")
    return got.select(
        "doc_id",
        "n_paragraphs",
        F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"]))), ",").alias("families"),
        F.size(known).cast("long").alias("n_confirmed"),
        (F.size("licences") - F.size(known)).cast("long").alias("n_unknown"),
        F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["paragraph"], x["family"])), ",").alias("paragraphs"),
    )
