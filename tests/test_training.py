"""Folds, early stopping, stacked predictions and studies."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import evaluate, folds, training

FEATURES = ["f", "noise"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    days = np.arange(900)
    f, noise = rng.uniform(0, 3, 900), rng.normal(size=900)
    label = np.where(rng.random(900) < 0.1, rng.integers(0, 3, 900), f.astype(int))
    rows = spark.createDataFrame([("A", int(k), float(a), float(b), int(y)) for k, a, b, y in zip(days, f, noise, label, strict=True)], "symbol string, k int, f double, noise double, label int")
    rows = rows.withColumn("ts", F.expr("cast(timestampadd(DAY, k, timestamp'2020-01-01') as timestamp_ntz)")).withColumn("label", F.when(F.col("k") % 50 == 7, -1).otherwise(F.col("label")))
    cuts = folds.walk_forward(rows, 12, 4, 6, 5)
    return rows, cuts, training.stored_folds(rows, cuts, FEATURES, f"file://{tmp_path_factory.mktemp('folds')}/t")


def test_parts_of_the_stored_folds(table):
    rows, cuts, stored = table
    spans = {(r.fold, r.part): (r.lo, r.hi, r.n) for r in stored.groupBy("fold", "part").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n")).collect()}
    assert {k for k, _ in spans} == {r.fold for r in cuts.collect()} and len(cuts.collect()) >= 2
    for k in {k for k, _ in spans}:
        train, stop, val = (spans[k, p] for p in ("train", "stop", "val"))
        assert train[1] < stop[0] and stop[1] < val[0] and (val[0] - stop[1]).days >= 5
        assert 0.13 < stop[2] / (stop[2] + train[2]) < 0.17
    assert stored.where("label < 0").count() == 0


def test_rounds_stop_and_predictions_are_stacked(table):
    rows, cuts, stored = table
    made = training.walk_forward(stored, FEATURES, rounds=30, depth=2, gain=0.02)
    assert set(made.rounds) == {r.fold for r in cuts.collect()}
    assert all(max(r) < 30 for r in made.rounds.values())
    whole = made.predictions.toPandas()
    want = stored.where("part = 'val'").select("symbol", "ts", "fold", "label").toPandas()
    key = ["fold", "ts"]
    assert whole.sort_values(key)[["symbol", "ts", "fold", "label"]].values.tolist() == want.sort_values(key)[["symbol", "ts", "fold", "label"]].values.tolist()
    assert np.allclose(whole[["p0", "p1", "p2"]].sum(axis=1), 1)
    report = {r.fold: r for r in made.report().collect()}
    for k, r in report.items():
        own = whole[whole["fold"] == k]
        p = own[["p0", "p1", "p2"]].to_numpy()
        assert abs(r.log_loss + np.log(p[np.arange(len(own)), own["label"]]).mean()) < 1e-9
        assert r.accuracy == (p.argmax(1) == own["label"]).mean() > 0.8 and r.log_loss < r.prior_log_loss and r.rounds == max(made.rounds[k])
    again = training.walk_forward(stored.where("fold = 0"), FEATURES, rounds=30, depth=2, gain=0.02).predictions.toPandas()
    assert np.allclose(again.sort_values(key)[["p0", "p1", "p2"]], whole[whole["fold"] == 0].sort_values(key)[["p0", "p1", "p2"]], atol=1e-12)


def test_no_fold_is_an_error(table):
    rows, cuts, stored = table
    with pytest.raises(ValueError, match="no fold"):
        training.walk_forward(stored.limit(0), FEATURES)


def surface(p):
    return (math.log10(p["rate"]) + 2) ** 2 + 0.3 * (p["depth"] - 7) ** 2 + (0 if p["kind"] == "b" else 3) + 2 * (p["share"] - 0.3) ** 2


SPACE = {"rate": (1e-4, 1.0, "log"), "depth": (2, 12), "share": (0.0, 1.0), "kind": ["a", "b", "c"]}


def test_study_beats_random_search():
    ahead = 0
    for seed in range(12):
        study = training.Study(SPACE, seed)
        best = study.run(lambda p, report: surface(p), 50)
        rng = random.Random(seed)
        drawn = min(surface({"rate": 10 ** rng.uniform(-4, 0), "depth": rng.randint(2, 12), "share": rng.random(), "kind": rng.choice("abc")}) for _ in range(50))
        ahead += best.value < drawn
        assert all(1e-4 <= t.params["rate"] <= 1 and 2 <= t.params["depth"] <= 12 and isinstance(t.params["depth"], int) for t in study.trials)
    assert ahead >= 9


def test_study_repeats_and_prunes():
    def objective(p, report):
        for k in range(4):
            report(surface(p) + 1 / (k + 1))
        return surface(p)

    a, b = training.Study(SPACE, 3), training.Study(SPACE, 3)
    x, y = a.run(objective, 40), b.run(objective, 40)
    assert [t.params for t in a.trials] == [t.params for t in b.trials] and x.value == y.value
    assert sum(t.pruned for t in a.trials) > 5 and all(len(t.steps) < 4 for t in a.trials if t.pruned)
    assert x.value == min(surface(t.params) for t in a.trials if not t.pruned)


def test_tuned_over_stored_folds(table):
    stored = table[2]
    study = training.tuned(stored, FEATURES, {"rounds": (1, 4), "depth": [1, 2]}, trials=3, folds=[0, 1])
    assert len(study.trials) == 3 and all(len(t.steps) == 2 and t.value == t.steps[-1] for t in study.trials)
    best = min(study.trials, key=lambda t: t.value)
    again = training.walk_forward(stored.where("fold = 0"), FEATURES, **best.params)
    assert abs(evaluate.log_loss(again.predictions).first()["log_loss"] - best.steps[0]) < 1e-9
