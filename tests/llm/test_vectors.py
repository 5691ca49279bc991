"""Top-k search and hard negatives against loops over all pairs, with odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import hard_negatives, tiles, topk

SCHEMA = "vec_id long, embedding array<double>, label int"
CLASH = ["score", "rank", "query_id", "node", "tile", "vector", "top", "anchor_id", "a.b"]


def odd_rows():
    rng = random.Random(7)
    vector = lambda n=6: [rng.choice([-1, 1]) * rng.random() for _ in range(n)]
    same = vector()
    rows = [(i, vector(), i % 3) for i in range(400)]
    rows += [(1000 + i, same, i % 2) for i in range(90)]  # one vector many times: ties
    rows += [(100, vector(), 0), (100, vector(), 1), (None, same, 0), (None, vector(), 2), (-200, vector(), 1)]  # repeated and null ids
    rows += [(2000, None, 0), (2100, [0.5, None, 0.1, 0.1, 0.1, 0.1], 0), (2200, [0.5, float("nan"), 0.1, 0.1, 0.1, 0.1], 1), (2300, [float("inf")] * 6, 1), (2400, vector(), None)]
    rows += [(2500, [], 1), (2600, vector(3), 0), (2700, vector(40), 0), (2800, [3e5] * 6, 0), (2900, [3e5] * 5 + [2.9e5], 1), (3000, [1e14] * 6, 2), (3100, [-1e14] * 6, 2)]
    return rows


def integers(rows):
    return [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def product(a, b):
    return max(-tiles.MOST, min(tiles.MOST, sum(x * y for x, y in zip(a, b, strict=False))))


def ranked(found):
    return sorted(found, key=lambda f: (-f[1], f[0] is None, f[0] or 0))


def test_products_are_exact():
    rng = np.random.default_rng(0)
    a = np.floor(np.vstack([rng.normal(0, 100, (5, 9)), rng.normal(0, 1e5, (5, 9)), rng.normal(0, 1e9, (5, 9)), rng.normal(0, 1e30, (2, 9))]))
    b = np.floor(np.vstack([rng.normal(0, 100, (4, 11)), rng.normal(0, 1e6, (4, 11)), rng.normal(0, 1e8, (4, 11))]))
    out = tiles.products(a, b)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            assert out[i, j] == product([int(v) for v in x], [int(v) for v in y])
    assert tiles.products(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0] * 3] * 2


def test_best_takes_first_of_equal_scores():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4, 7, 300):
        s = rng.integers(0, 6, n)
        assert tiles.best(s, 5).tolist() == sorted(range(n), key=lambda i: (-s[i], i))[:5]


@pytest.mark.parametrize("rows", [8192, 7])
def test_top_k_of_odd_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(topk, "ROWS", rows)
    monkeypatch.setattr(topk, "QUERIES", min(rows, 512))
    monkeypatch.setattr(tiles, "FAN", 4 if rows == 7 else 32)
    df = spark.createDataFrame(odd_rows(), SCHEMA).select("*", *[F.lit(1).alias(c) for c in CLASH])
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.neighbours(df).collect()), key=str)
    there = integers(odd_rows())
    want = []
    for q, (i, v, _) in enumerate(there):
        if i is not None and i % 50 == 0:
            first = ranked([(j, product(v, w)) for c, (j, w, _) in enumerate(there) if c != q])[:5]
            want += [(i, k + 1, j, s) for k, (j, s) in enumerate(first)]
    assert got == sorted(want, key=str) and len(got) > 100


def test_few_and_no_rows(spark):
    assert topk.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0 == hard_negatives.mined(spark.createDataFrame([], SCHEMA)).count()
    two = spark.createDataFrame([(0, [1.0], 1), (50, [2.0], 1)], SCHEMA)
    assert sorted(map(tuple, topk.neighbours(two).collect())) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert hard_negatives.mined(two).count() == 0
    assert topk.neighbours(two.limit(1)).count() == 0
    assert topk.neighbours(spark.createDataFrame([(0, None, None)], SCHEMA)).count() == 0


@pytest.mark.parametrize(("rows", "dims"), [(4096, 32), (7, 2), (50, 5)])
def test_hard_negatives_of_odd_rows(spark, monkeypatch, rows, dims):
    monkeypatch.setattr(hard_negatives, "ROWS", rows)
    monkeypatch.setattr(hard_negatives, "ANCHORS", min(rows, 256))
    data = [(i, v, g) for i, v, g in odd_rows() if i is None or i < 3000]
    df = spark.createDataFrame(data, SCHEMA).select("*", *[F.lit(1).alias(c) for c in CLASH])
    got = sorted((tuple(r) for r in hard_negatives.mined(df, every=50, dims=dims).collect()), key=str)
    there = [x for x in integers(data) if x[2] is not None]
    want = []
    for q, (i, v, g) in enumerate(there):
        if i is None or i % 50:
            continue
        scores = [(j, product(v, w), h) for c, (j, w, h) in enumerate(there) if c != q]
        for p, ps in ranked([(j, s) for j, s, h in scores if h == g])[:5]:
            hard = ranked([(j, s) for j, s, h in scores if h != g and 80 * ps <= 100 * s <= 100 * ps])[:5]
            want += [(i, p, k + 1, n, ps, ns) for k, (n, ns) in enumerate(hard)]
    assert got == sorted(want, key=str) and len(got) > 100


def test_sums_stop_at_the_range_of_longs():
    most = tiles.MOST
    assert hard_negatives.added(np.array([most, -most, 5, most]), np.array([1, -9, 6, -most])).tolist() == [most, -most, 11, 0]
    assert [hard_negatives.least_of(x, 80) for x in (10, 11, 1, 0)] == [8, 9, 1, 0]
