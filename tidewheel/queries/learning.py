"""Models over bars: trained on the past, calibrated, judged on the future, saved and loaded.

Fitted trees have no SQL; the tests hold the split, the probabilities and the saved model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import exprs as x
from tidewheel.operators import explain, folds, labels, model, training
from tidewheel.plans.config import DEFAULT
from tidewheel.queries.base import c, daily, hourly, query, shown
from tidewheel.queries.trading import fresh, with_range

FEATURES = ["body", "range", "gap", "change"]


def prepared(s, d, bars=hourly) -> DataFrame:
    """Labelled bars with four plain features."""
    df = labels.triple_barrier(with_range(bars(s, d)), DEFAULT)
    return df.withColumns({"body": c("close") - c("open"), "range": c("high") - c("low"), "gap": x.ratio(c("close") - x.sma("close", 20), x.deviation("close", 20)), "change": x.diff("close", 3)})


@query("out_of_time")
def out_of_time(s, d):
    """Boosted trees fitted on each symbol's first bars, calibrated on the next, judged on the last."""
    base, n = fresh(s, "future"), iter(range(9))

    def cut(df: DataFrame) -> DataFrame:
        path = f"{base}/table-{next(n)}"
        df.write.parquet(path)
        return s.read.schema(df.schema).parquet(path)

    return model.out_of_time(prepared(s, d), FEATURES, rounds=3, depth=2, cut=cut)


@query("saved_model")
def saved_model(s, d):
    """Probabilities of a model that was saved and loaded again."""
    rows = prepared(s, d).where("label >= 0")
    path = f"{fresh(s, 'model')}/boosted"
    model.train_boosted(rows, FEATURES, rounds=2, depth=2).save(path)
    return shown(model.scored(model.OneVsRest.load(path), rows, FEATURES).withColumns({p: F.round(p, 6) for p in model.P}), *model.P)


@query("feature_importance")
def feature_importance(s, d):
    """How much each feature matters to a small model's log loss."""
    rows = prepared(s, d).where("label >= 0")
    return model.importance(model.train_boosted(rows, FEATURES, rounds=2, depth=2), rows, FEATURES)


def walked(s, d) -> training.WalkForward:
    """Boosted trees walked forward over seven years of daily bars: three years to train, one to judge, then a year on."""
    rows = prepared(s, d, daily)
    cuts = folds.walk_forward(rows, 36, 12, 12, DEFAULT.horizon)
    return training.walk_forward(training.stored_folds(rows, cuts, FEATURES, f"{fresh(s, 'folds')}/table"), FEATURES, rounds=6, depth=2)


@query("oof_stack")
def oof_stack(s, d):
    """Predictions of all folds, each by a model that has seen nothing of its time."""
    return walked(s, d).predictions


@query("walk_forward_report")
def walk_forward_report(s, d):
    """Rounds, loss and accuracy of each fold."""
    return walked(s, d).report()


@query("tree_attributions")
def tree_attributions(s, d):
    """What each feature adds to the margins of a boosted model, ranked for each class."""
    rows = prepared(s, d).where("label >= 0")
    return explain.ranked(explain.attributions(model.train_boosted(rows, FEATURES, rounds=2, depth=2), rows, FEATURES), FEATURES)
