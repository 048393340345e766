"""Hard negatives against brute force, on planted ties, repeated rows and rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import hard_negatives


def brute(rows, positives=5, negatives=5, low=80, high=100, scale=256):
    """rows: (vec_id, vector, label); an independent loop over all pairs."""
    good = [(i, [int(np.floor(scale * float(x))) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (aid, av, ay) in enumerate(good):
        if aid % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v, strict=False)), i, n) for n, (i, v, _) in enumerate(good) if n != a)
        for ps, pid, _ in [s for s in scored if good[s[2]][2] == ay][:positives]:
            inside = [s for s in scored if good[s[2]][2] != ay and low * -ps <= 100 * -s[0] <= high * -ps][:negatives]
            out += [(aid, pid, k + 1, i, -ps, -s) for k, (s, i, _) in enumerate(inside)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("rank", F.lit("x")).withColumn("key", F.lit(None).cast("string"))
    return sorted(tuple(r) for r in hard_negatives.mined(df, F.col("vec_id") % 100 == 0, **more).collect())


def vectors(n, dim, seed, labels=4):
    r = np.random.default_rng(seed)
    v = np.round(r.normal(size=(n, dim)) * 8 + r.normal(size=dim) * 4) / 16
    return [(i, [float(x) for x in v[i]], int(r.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("n", "dim", "block", "least"), [(700, 12, 1 << 20, 1024), (700, 12, 12 * 50, 10), (500, 3, 3 * 64, 16), (300, 40, 40 * 100, 10)])
def test_against_brute_force(spark, monkeypatch, n, dim, block, least):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "LEAST", least)
    monkeypatch.setattr(hard_negatives, "ANCHORS", dim * 3)
    rows = vectors(n, dim, n + dim)
    want = brute(rows)
    assert len(want) > 20 and found(spark, rows) == want


def test_other_bounds(spark):
    rows = vectors(400, 8, 5, labels=2)
    assert found(spark, rows, positives=3, negatives=9, low=50, high=90, scale=100) == brute(rows, 3, 9, 50, 90, 100)


def test_one_vector_of_a_third_of_the_rows(spark):
    rows = vectors(300, 6, 7)
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(150)]
    assert found(spark, rows) == brute(rows)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.9, 0.0], 2), (3, None, 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 2), (6, [1.0, None], 2), (7, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (8, [0.85], 2), (9, [], 2), (200, [-1.0, 0.0], 3), (201, [0.5, 0.0], 3)]
    assert found(spark, rows) == brute(rows)


def test_repeated_rows_and_large_components(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (3, [1.0, 1.9], 2), (3, [1.0, 1.9], 2), (4, [1.0, 1.8], 1)]
    assert found(spark, rows) == brute(rows)
    big = [(0, [400_000.0, 1.0], 1), (1, [400_000.0, 0.0], 1), (2, [390_000.0, 3.0], 2), (3, [390_000.0, 2.0], 2)]
    assert found(spark, big) == brute(big)
    assert found(spark, [(0, [1e30], 1), (1, [1e30], 1), (2, [1e30], 2)]) == [(0, 1, 1, 2, 1 << 54, 1 << 54)]


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1)]) == []
    assert found(spark, [(0, [1.0], 1)]) == []
