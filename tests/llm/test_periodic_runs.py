"""Periodic runs against brute force over all periods, and extensions against comparing word by word."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tracelake.llm import periodic_runs as pr
from tracelake.llm.common import stage_path

SF = "/root/testdata/sf0.001"


def brute(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        begin = None
        for i, x in enumerate(same):
            if x and begin is None:
                begin = i
            elif not x and begin is not None:
                if i + q - begin >= max(least, times * q):
                    found.setdefault((begin, i + q), q)
                begin = None
    return sorted((s, e - s, q) for (s, e), q in found.items())


def digest(doc_id, text):
    """The row of the query, by its definition."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x).hexdigest()
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(kept))


def texts(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        while len(words) < r.choice([5, 60, 200, 400]):
            unit = [r.choice("abcdefgh"[: r.choice([1, 2, 3, 8])]) for _ in range(r.choice([1, 1, 2, 3, 5, 8, 9, 13, 20, 33]))]
            words += (unit * r.choice([1, 2, 3, 4, 9, 30]))[: r.randint(1, 160)]
            words += [r.choice("abcxyz") for _ in range(r.choice([0, 0, 1, 4]))]
        out.append(r.choice([" ", "\n", "\t \x0b"]).join(words))
    return out


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 2), (1, 2), (40, 4)])
def test_against_brute_force(least, times):
    shape = pr.Shape(least, times)
    split = [x.split() for x in texts(least, 120)] + [[], ["a"], ["a"] * 24, ["a"] * 23, ["a", "b", "c"] * 8]
    number = {w: k for k, w in enumerate(sorted({w for x in split for w in x}))}
    got = pr.runs_of(np.array([number[w] for x in split for w in x]), np.array([len(x) for x in split]), shape)
    want = {k: w for k, x in enumerate(split) if (w := brute(x, least, times))}
    assert {k: list(map(tuple, x.tolist())) for k, x in got.items()} == want and len(want) > 20


@pytest.mark.parametrize("seed", range(4))
def test_extensions(seed):
    r = np.random.default_rng(seed)
    ids = np.append(np.tile(r.integers(0, 3, r.integers(1, 40)), 30)[: r.integers(20, 600)], 9)
    ids[r.integers(0, len(ids) - 1, 3)] = 1
    extend = pr.Extensions(ids)
    i, j = r.integers(0, len(ids), (2, 4000))
    i, j = i[i != j], j[i != j]
    naive = [next(d for d in range(len(ids) + 1) if max(a, b) + d >= len(ids) or ids[a + d] != ids[b + d]) for a, b in zip(i, j, strict=True)]
    assert extend(i, j).tolist() == naive


def test_query_against_brute_force(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(texts(9, 300))] + [(None, "a " * 30), (None, None), (7, ""), (7, " \n"), (8, "é ü " * 40), (9, "É é " * 40), (3, "a b c " * 30)]
    path = stage_path(spark, "periodic")
    spark.createDataFrame([(i, t, "x", [1], 5) for i, t in rows], "doc_id bigint, text string, collapsed string, runs array<int>, n bigint").write.parquet(f"{path}/documents.parquet")
    key = lambda r: tuple(map(str, r))
    want = sorted([digest(*r) for r in rows], key=key)
    for words in (pr.CHUNK_WORDS, 50):
        monkeypatch.setattr(pr, "CHUNK_WORDS", words)
        got = sorted([tuple(r)[:8] for r in pr.op11_periodic_runs(spark, path).collect()], key=key)
        assert got == want


def test_given_documents(spark):
    got = {r.doc_id: tuple(r)[:8] for r in pr.op11_periodic_runs(spark, SF).collect()}
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text.split()) < 1500]
    assert len(rows) > 100 and all(got[r.doc_id] == digest(r.doc_id, r.text) for r in rows)


def test_one_very_long_text(spark):
    r = random.Random(3)
    unit = [f"w{r.randrange(4000)}" for _ in range(30_000)]
    words = unit * 4 + ["end"] + ["x", "y"] * 30_000
    got = pr.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")).first()
    assert [tuple(x) for x in got.runs] == [(0, 120_000, 30_000), (120_001, 60_000, 2)] and got.collapsed == " ".join([*unit, "end", "x", "y"])


def test_empty_table(spark):
    assert pr.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
