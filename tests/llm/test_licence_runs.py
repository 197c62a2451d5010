"""Notices over several lines and inside prose."""

import math
import random
import textwrap

import duckdb
import numpy as np
import pytest

from loomql.llm import licence_texts, licences
from loomql.llm.shared import read_table


def test_wrapped_and_embedded_notices(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    wrapped = {"MIT": 0, "BSD": 0, "GPL": 1, "Zlib": 1, "ISC": 0}  # the texts by their place
    rows, want = [], {}
    for family, n in wrapped.items():
        notice = licence_texts.TEXTS[family][n]
        comment = textwrap.fill(notice, 60, initial_indent=" * ", subsequent_indent=" * ")
        prose = f"The committee met in the old hall and spoke of the harvest for hours. {notice}. Nobody knew who had written it, and the river went on past the mill. " * 2
        for text, first in ((textwrap.fill(notice, 70), 0), ("A title\n\n" + comment + "\n\nint main() {}", 1), ("x\n" + textwrap.fill(prose, 80), None), (prose, 0)):
            want[len(rows)] = (family, first)
            rows.append((len(rows), text))
    talk = len(rows)
    rows.append((talk, "\n".join(licence_texts.TALK)))
    found = licences.findings(spark.createDataFrame(rows, "doc_id long, text string"), model=licences.train(docs)).collect()
    for r in found:
        good = [f for f in r.findings if f.confirmed]
        if r.doc_id == talk:
            assert not good
        else:
            family, first = want[r.doc_id]
            assert {f.family for f in good} == {family} and (first is None or good[0].paragraph == first)
            assert len(good) == len(r.findings) or first is None


@pytest.fixture(scope="module")
def model():
    docs = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()
    return licences.fit(sorted({line for (t,) in docs for line in t.split("\n") if line.strip()}))


#: Written by hand, not made from the forms: text, the families that it grants, and those that it only speaks of.
WRITTEN = [
    ("ISC License", {"ISC"}),
    ("This program is made available to everybody under the Eclipse Public License, version 2.0, and nothing else.", {"EPL"}),
    ("Our server code is shared under the GNU Affero General Public License, version 3.", {"AGPL"}),
    ("Apache License, Version 1.1", {"Apache-1.1"}),
    ("The library is not licensed under the GNU GPL.", set()),
    ("It is not released under the MIT License.", set()),
    ("Parts of it were never published under the Apache License, Version 2.0.", set()),
    ("/*\n * SPDX-License-Identifier: MIT\n */\nint main() {}", {"MIT"}),
    ("# SPDX-License-Identifier: LGPL-2.1-or-later", {"LGPL"}),
    ("Pictures: CC BY-ND 4.0", {"CC-BY-ND"}),
    ("All photographs may be used under the terms of a CC BY-NC-SA 4.0 licence.", {"CC-BY-NC-SA"}),
    ("The text may be shared under the\nCreative Commons Attribution-NonCommercial-NoDerivatives 4.0\nInternational License.", {"CC-BY-NC-ND"}),
    ("Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.", {"BSD"}),
    ("You can choose: it is licensed under the MIT License or under the Apache License, Version 2.0.", {"MIT", "Apache-2.0"}),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software", set()),
    ("The fonts are distributed under the SIL Open Font License.", {"OFL"}),
    ("We sell this under the Acme Commercial License.", set()),
    ("He bought a fishing license and the permit of the county.", set()),
    ("Under the terms of the treaty the river is free for all ships.", set()),
    ("The museum opened a show on public art under new conditions.", set()),
]


def test_notices_written_by_hand(spark, model):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WRITTEN)], "doc_id long, text string")
    for r in licences.findings(frame, model=model).collect():
        assert {f.family for f in r.findings if f.confirmed} == WRITTEN[r.doc_id][1], (WRITTEN[r.doc_id], r.findings)


def test_calibration_off_the_templates(model):
    """The mean gap between a prediction's probability and whether it is right, on sentences not made from forms."""
    units = [(t, f) for t, fs in WRITTEN for f in fs or ["unknown"] if len(fs) < 2 and "not " not in t and "never" not in t and "unencumbered" not in t]
    family, sure = licences.predict(model, [licences.word_hashes(licences.Words(), t.encode()) for t, _ in units])
    right = np.array([licences.FAMILIES[f] == want for f, (_, want) in zip(family, units)])
    assert right.mean() > 0.75 and abs(sure.mean() - right.mean()) < 0.2


def test_probabilities_against_plain_version(model):
    """Features and softmax by hand, word by word."""
    for text in ("Licensed under the MIT License.", "one", "The terms of the GNU GPL, the GNU GPL and a b c"):
        words = [licences.plain(w) for w in text.split()]
        h = [licences.hashed(w) for w in words if w]
        fold = lambda x: (x * 0xD6E8FEB86659FD93 % 2**64) >> 49
        cells = {fold(x) for x in h} | {fold((x * 0x9E3779B97F4A7C15 + y) % 2**64) for x, y in zip(h, h[1:])}
        z = [(sum(float(model["w"][c, k]) for c in cells) / len(cells) ** 0.5 + float(model["c"][k])) / model["heat"] for k in range(len(licences.FAMILIES))]
        e = [math.exp(x - max(z)) for x in z]
        family, sure = licences.predict(model, [licences.word_hashes(licences.Words(), text.encode())] * 2)
        assert family[0] == family[1] == e.index(max(e)) and abs(sure[1] - max(e) / sum(e)) < 1e-4


def test_order_counts(model):
    text = licences.Words(), licence_texts.TEXTS["MIT"][1]
    h = licences.word_hashes(text[0], text[1].encode())
    assert licences.likeness(model, h, licences.FAMILIES.index("MIT")) == 1 and licences.likeness(model, h[::-1].copy(), licences.FAMILIES.index("MIT")) < 0.5
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert licences.in_order(a, b) == table[-1][-1]


def test_ascii_words_are_hashed_without_a_step_for_each_letter(monkeypatch):
    odd = ["(Licence),", "LICENCE", "x" * 5000 + "-", "--", "\x00\x7f", "naïve", "Straße's", "İstanbul", "sublicence²", "٣licence", "�"]
    raw = [w.encode() for w in odd] + [chr(c).encode() for c in range(0x3000)] + [b"lic\xffence", b"\xc3"]
    by_letters = {w: licences.hashed(p) if (p := licences.plain(w.decode("utf-8", "replace"))) else 0 for w in raw}
    words = licences.Words()
    assert {w: words[w] for w in raw} == by_letters

    def slow(word):
        raise AssertionError(word)

    monkeypatch.setattr(licences, "plain", slow)
    assert licences.Words()[b"(Licence),"] == by_letters[b"(Licence),"]


def test_features_of_a_paragraph_count_once():
    rng = np.random.default_rng(0)
    model = {"w": rng.standard_normal((licences.CELLS, 3)).astype(np.float32), "c": np.zeros(3), "heat": 1.0}
    pool = rng.integers(1, 1 << 62, 50).astype(np.uint64)
    lines = [rng.choice(pool, n) for n in (1, 2, 7, 400, 1)]
    _, sure = licences.predict(model, lines)
    plainly = [licences.softmax(model["w"][f].sum(axis=0) / np.sqrt(len(f))).max() for f in map(licences.features, lines)]
    assert np.allclose(sure, plainly, rtol=1e-4)
