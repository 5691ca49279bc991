"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidewheel import catalog
from tidewheel.operators import model
from tidewheel.queries import base, learning, trading


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    a, b = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    keys = [k for k in ("symbol", "scheme", "ts", "entry_idx", "threshold") if k in cols] + cols
    a, b = (x[cols].sort_values(keys).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=1.5e-6)


def test_halves_round_as_in_sql(spark):
    """Halves of the last decimal that a double holds a little below or above, and what can't be scaled."""
    values = [s * (k + 0.5) / 10**6 for k in range(0, 200_000, 37) for s in (1, -1)] + [-0.07312249999999998, 0.0, 9.1e15, 1e305, -1e305, float("inf"), None]
    made = base.rounded(spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k long, x double")).orderBy("k").toPandas()["x"]
    own = pd.DataFrame({"k": range(len(values)), "x": pd.array(values, "Float64")})
    wanted = duckdb.sql(f"SELECT {base.r6('x')} AS x FROM own ORDER BY k").df()["x"]
    pd.testing.assert_series_equal(made, wanted, rtol=0, atol=0)


def test_funding_features_to_the_last_digit(spark, sf):
    """Means of eight rates of five decimals often end on a half of the last decimal."""
    events = sf.replace("sf0.001", "sf0.01")
    a = catalog.QUERIES["funding_features"](spark, events).toPandas()
    b = duckdb.sql(f"WITH events AS (FROM '{events}/events.parquet') SELECT * FROM ({catalog.ORACLES['funding_features']})").df()
    a, b = (x.sort_values(["symbol", "ts"]).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=0)


def test_every_other_query_is_held_by_a_test():
    """Queries without SQL, each with the test of its values."""
    held = {"feature_matrix": "test_loops", "fractal_measures": "test_loops", "swing_ratio": "test_loops", "price_channels": "test_zones", "clustered_trend": "test_zones", "lorentzian_neighbours": "test_zones"}
    here = {"seeded_sample", "label_permutation", "out_of_time", "saved_model", "feature_importance", "oof_stack", "walk_forward_report", "tree_attributions"}
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set(held) | here


def test_zones_and_neighbours_have_values(spark, sf):
    trend = catalog.QUERIES["clustered_trend"](spark, sf).toPandas()
    assert trend["cluster_factor"].dropna().between(1, 5).all() and trend["cluster_factor"].notna().mean() > 0.5
    votes = catalog.QUERIES["lorentzian_neighbours"](spark, sf).toPandas()
    assert votes["lorentzian_vote"].abs().max() <= 8 and set(votes["lorentzian_signal"]) == {-1.0, 0.0, 1.0}
    zones = catalog.QUERIES["price_channels"](spark, sf).toPandas()
    assert (zones["top"] >= zones["bottom"]).all() and zones["rank"].between(1, 6).all()
    by = zones.sort_values(["symbol", "ts", "rank"])
    assert (by.groupby(["symbol", "ts"])["strength"].diff().dropna() <= 0).all()


def test_sample_and_permutation(spark, sf):
    rows = catalog.QUERIES["seeded_sample"](spark, sf).toPandas()
    bars = catalog.QUERIES["bars_1h"](spark, sf).toPandas()
    assert len(rows) == 100 == len(rows.drop_duplicates(["symbol", "ts"])) and len(rows.merge(bars, on=["symbol", "ts", "close"])) == 100
    made = trading.probabilities(spark, sf).groupBy("symbol", "label").count().toPandas()
    dealt = catalog.QUERIES["label_permutation"](spark, sf).groupBy("symbol", "label").count().toPandas()
    key = ["symbol", "label", "count"]
    assert made[key].sort_values(key).values.tolist() == dealt[key].sort_values(key).values.tolist()


def test_models(spark, sf):
    rows = learning.prepared(spark, sf).where("label >= 0").cache()
    fitted = model.train_boosted(rows, learning.FEATURES, rounds=2, depth=2)
    key = ["symbol", "ts"]
    saved = catalog.QUERIES["saved_model"](spark, sf).toPandas().sort_values(key).reset_index(drop=True)
    own = model.scored(fitted, rows, learning.FEATURES).select(*key, *model.P).toPandas().sort_values(key).reset_index(drop=True)
    assert (saved[list(model.P)] - own[list(model.P)]).abs().max().max() < 1e-5
    assert ((own[list(model.P)].sum(axis=1) - 1).abs() < 1e-9).all()
    found = {r.feature: r.importance for r in catalog.QUERIES["feature_importance"](spark, sf).collect()}
    assert set(found) == set(learning.FEATURES) and all(abs(v) < 1 for v in found.values()) and max(found.values()) > 0
    one = {r.feature: r.importance for r in model.importance(fitted, rows, learning.FEATURES, block=1).collect()}
    assert all(abs(one[f] - found[f]) < 1e-5 for f in found)
    assert model.importance(fitted, rows, learning.FEATURES[:1] + learning.FEATURES[1:], most=50).count() == len(learning.FEATURES)
    future = catalog.QUERIES["out_of_time"](spark, sf).toPandas()
    assert (future["part"] == "future").all() and (future["n"] > 0).all() and future[["raw_log_loss", "log_loss"]].stack().between(0, 40).all()


def test_walk_forward_queries(spark, sf):
    stack = catalog.QUERIES["oof_stack"](spark, sf).toPandas()
    assert not stack.duplicated(["symbol", "ts", "fold"]).any() and stack["fold"].nunique() >= 2
    assert ((stack[["p0", "p1", "p2"]].sum(axis=1) - 1).abs() < 1e-5).all() and stack["label"].between(0, 2).all()
    report = catalog.QUERIES["walk_forward_report"](spark, sf).toPandas()
    assert set(report["fold"]) == set(stack["fold"]) and report["rounds"].between(1, 6).all()
    assert report.set_index("fold")["n"].to_dict() == stack.groupby("fold").size().to_dict()
    shares = catalog.QUERIES["tree_attributions"](spark, sf).toPandas()
    assert set(shares["feature"]) == set(learning.FEATURES) and (shares.groupby("class")["cum_share"].max().sub(1).abs() < 1e-5).all()
