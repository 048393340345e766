"""Repeated strings in bytes and in words, with rows that repeat often."""

import re
from collections import Counter

import pytest

from tracelake.llm import repeats

from .test_text_operators import frame, words_of


def covered(symbols, length):
    """The covered places of each list of symbols."""
    count = Counter(tuple(t[k : k + length]) for t in symbols for k in range(len(t) - length + 1))
    return [{p for k in range(len(t) - length + 1) if count[tuple(t[k : k + length])] > 1 for p in range(k, k + length)} for t in symbols]


@pytest.fixture(scope="module")
def rows():
    passage = words_of(60, 1)
    often = " ".join(words_of(90, 2))
    out = [(7, often)] * 50 + [(None, often)] + [(None, " ".join(words_of(70, 10 + k) + passage)) for k in range(4)] + [(None, None)]
    out += [(100 + k, " ".join(words_of(30, 20 + k) + passage[k : 52 + k] + words_of(30, 40 + k))) for k in range(4)]
    return out + [(200, " ".join(words_of(55, 3) * 3)), (201, " ".join(words_of(49, 4))), (202, " ".join(words_of(49, 4) + ["end"])), (203, "")]


def test_rows_that_repeat_often(spark, rows):
    texts = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), t, c in zip(rows, texts, covered(texts, 120), strict=True):
        want[(i, len(t), bytes(b for k, b in enumerate(t) if k not in c))] += 1
    got = repeats.remove_repeats(frame(spark, rows), 120, 30).select("doc_id", "n_bytes", "kept").collect()
    assert Counter((a, b, bytes(c)) for a, b, c in got) == want


def test_passages_of_words(spark, rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    want = Counter((i, len(w), len(c)) for (i, _), w, c in zip(rows, words, covered(words, 50), strict=True))
    found = repeats.repeated_words(frame(spark, rows)).withColumn("n", repeats.runs()[0])
    assert Counter((r.doc_id, r.n_words, r.n) for r in found.collect()) == want
    assert sum(n > 0 for _, _, n in want.elements()) > 55
