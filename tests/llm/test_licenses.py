"""Occurrences of license texts against an alignment without any band."""

import random
import re

import numpy as np
import pytest

from tracelake.llm import license_scan

from .test_text_operators import frame, lcs, words_of

MIT = license_scan.TEMPLATES["mit"]


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())


def found(spark, texts):
    out = {}
    for r in license_scan.scan_licenses(frame(spark, list(enumerate(texts)))).collect():
        out.setdefault((r.doc_id, r.template), []).append((r.first_word, r.end_word, r.matched))
    return {k: sorted(v) for k, v in out.items()}


def test_insertions_and_repeats(spark):
    w, line = MIT.split(), "Released under the MIT License."
    half = len(w) // 2
    inserted = [" ".join(w[:cut] + words_of(n, n) + w[cut:]) for cut, n in ((half, 9), (half, 40), (4 * len(w) // 5, 20))]
    texts = [*inserted, "\n".join([line] * 30), " ".join([MIT] * 3), " ".join([*w[:-12], *w[12:]]), " ".join([*words_of(50, 1), line, *words_of(50, 2), line])]
    got = found(spark, texts)
    n = len(split(MIT))
    for i, t in enumerate(inserted):
        assert got[(i, "mit")] == [(0, len(split(t)), lcs(split(MIT), split(t)))] and got[(i, "mit")][0][2] == n
    assert got[(3, "mit-line")] == [(5 * k, 5 * k + 5, 5) for k in range(30)]
    assert got[(4, "mit")] == [(n * k, n * k + n, n) for k in range(3)]
    assert len(got[(5, "mit")]) == 2 and all(m >= 0.75 * n for _, _, m in got[(5, "mit")])
    assert [e - a for a, e, _ in got[(6, "mit-line")]] == [5, 5]


@pytest.mark.parametrize("seed", range(8))
def test_scattered_edits(seed):
    r = random.Random(seed)
    t, doc = license_scan.Templates({"mit": MIT}), []
    for x in split(MIT):
        doc += {0: [], 1: ["other"], 2: [x, *words_of(r.randrange(1, 15), seed)]}.get(r.randrange(40), [x])
    w = license_scan.tx.Words([" ".join(doc).encode()], license_scan.tx.ALNUM)
    p, _, at = t.hits(w)
    got = license_scan.occurrences(t.words[0], w.hash, p, at, 8, 0.75)
    assert [m for _, _, m in got] == [lcs(split(MIT), doc)]
    assert np.all(np.diff([x for a, e, _ in got for x in (a, e)]) >= 0)


def test_every_template(spark):
    names = sorted(license_scan.TEXTS)
    got = found(spark, [" ".join([*words_of(20, i), license_scan.TEXTS[n], *words_of(20, i)]) for i, n in enumerate(names)])
    for i, n in enumerate(names):
        size = len(split(license_scan.TEXTS[n]))
        assert got[(i, n)] == [(20, 20 + size, size)], n


def test_short_notices_count_word_for_word(spark):
    lines = {
        "Released under the BSD License.": None,
        "Released under the MIT License.": "mit-line",
        "licensed under MIT license": "mit-line",
        "SPDX-License-Identifier: MIT": "mit-line",
        "Licensed under CC BY 4.0.": "cc-by-4.0-line",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-line",
        "distributed under the GNU Lesser General Public License, version 3": "lgpl-3.0-line",
        "distributed under the GNU General Public License, version 2": "gpl-2.0-line",
        "Under the terms of the Mozilla Public License 2.0": "mpl-2.0-line",
        "Released under an MIT-like License.": None,
    }
    got = found(spark, [f"before {x} after" for x in lines])
    assert {k for k, _ in enumerate(lines) if any(i == k for i, _ in got)} == {k for k, v in enumerate(lines.values()) if v}
    for k, (line, name) in enumerate(lines.items()):
        if name:
            n = len(split(line))
            assert [(t, v) for (i, t), v in got.items() if i == k] == [(name, [(1, 1 + n, n)])], line
