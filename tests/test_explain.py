"""Attributions against the game they are the values of, played over all subsets."""

import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewheel.operators import explain, model

FEATURES = ["a", "b", "d", "e"]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] + x[:, 1] * (x[:, 2] > 0)) > 0.5).astype(int) + (x[:, 3] > 1)
    rows = spark.createDataFrame([("S", i, *map(float, r), int(min(v, 2))) for i, (r, v) in enumerate(zip(x, y, strict=True))], "symbol string, ts long, a double, b double, d double, e double, label int").withColumn("e", F.when(F.col("ts") % 17 != 0, F.col("e"))).cache()
    return rows, model.train_boosted(rows, FEATURES, rounds=3, depth=3)


def value(node, x, known):
    """The tree's value if only the features in ``known`` are."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    f, at = node.split().featureIndex(), node.split().threshold()
    left, right = node.leftChild(), node.rightChild()
    if f in known:
        return value(left if x[f] <= at else right, x, known)
    n, m = left.impurityStats().count(), right.impurityStats().count()
    return (n * value(left, x, known) + m * value(right, x, known)) / (n + m)


def test_values_of_all_subsets(fitted):
    rows, boosted = fitted
    trees = boosted.sides[0].stages[-1].trees[:2]
    for x in np.random.default_rng(2).normal(size=(6, 4)):
        for tree in trees:
            root = tree._call_java("rootNode")
            worth = {s: value(root, x, s) for k in range(5) for s in itertools.combinations(range(4), k)}
            want = [sum(factorial(len(s)) * factorial(3 - len(s)) / 24 * (worth[tuple(sorted((*s, i)))] - worth[s]) for s in worth if i not in s) for i in range(4)]
            found = explain.leaves(tree)
            assert np.allclose(explain.shared_out(x[None], found)[0], want, atol=1e-12)
            assert abs(explain.expected(found) - worth[()]) < 1e-12


def test_sum_to_the_margin(fitted):
    rows, boosted = fitted
    got = {(r["class"], r.ts): r for r in explain.attributions(boosted, rows, FEATURES).collect()}
    assert len(got) == 900
    ready = rows.withColumns({f: F.col(f).cast("double") for f in FEATURES})
    for k, side in enumerate(boosted.sides):
        for r in side.transform(ready).select("ts", (vector_to_array("rawPrediction")[1] * 2).alias("m")).collect():
            x = got[k, r.ts]
            assert abs(x.margin - r.m) < 1e-9 and abs(x.base + sum(x.shares) - x.margin) < 1e-9


def test_ranks(fitted):
    rows, boosted = fitted
    table = explain.ranked(explain.attributions(boosted, rows, FEATURES), FEATURES).orderBy("class", "rank").collect()
    assert [(r["class"], r["rank"]) for r in table] == [(k, n) for k in range(3) for n in (1, 2, 3, 4)]
    assert all(abs(table[4 * k + 3].cum_share - 1) < 1e-9 for k in range(3))
    assert all(x["class"] != y["class"] or x.mean_abs >= y.mean_abs for x, y in itertools.pairwise(table)) and {table[8].feature, table[9].feature} & {"e"}
    assert explain.attributions(boosted, rows.limit(0), FEATURES).count() == 0
