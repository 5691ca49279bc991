"""Classifiers on Spark ML: walk-forward training, calibration, importance, contributions, search, saved models.

Boosted three-class trees are not part of Spark ML: ``train_boosted`` fits boosted trees for each class against the rest and
shares out their odds; ``train`` is a random forest with the same interface.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, MinMaxScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.evaluate import P, log_loss
from tidewheel.operators.labels import balanced_weights

c = F.col


def vectors(features: list[str]) -> list:
    """Stages that fill gaps with the median and assemble a vector."""
    filled = [f"{f}__f" for f in features]
    return [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features")]


def scaled(features: list[str], least_variance: float = 0.0) -> list:
    """Stages that also drop constant features and scale to -1..1."""
    return [*vectors(features), VarianceThresholdSelector(varianceThreshold=least_variance, featuresCol="features", outputCol="varied"), MinMaxScaler(min=-1.0, max=1.0, inputCol="varied", outputCol="scaled")]


def train(rows: DataFrame, features: list[str], trees: int = 50, depth: int = 6, seed: int = 42):
    """A three-class model on balanced weights. Columns must be named: nothing is a feature just because it is there."""
    missing = [f for f in features if f not in rows.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    rows = balanced_weights(rows.withColumns({f: c(f).cast("double") for f in features}))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*vectors(features), forest]).fit(rows)


def train_side(rows: DataFrame, features: list[str], side: int, rounds: int = 20, depth: int = 4, seed: int = 42):
    """A boosted one-sided model; positives weigh as much as the rest."""
    rows = rows.withColumns({f: c(f).cast("double") for f in features}).withColumn("y", (c("label") == side).cast("double"))
    n = rows.agg(F.sum("y"), F.count("*")).first()
    ratio = (n[1] - n[0]) / max(1.0, n[0])
    rows = rows.withColumn("weight", F.when(c("y") == 1, ratio).otherwise(1.0))
    return Pipeline(stages=[*vectors(features), GBTClassifier(labelCol="y", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed)]).fit(rows)


def scored(model, rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with p0, p1, p2."""
    out = model.transform(rows.withColumns({f: c(f).cast("double") for f in features}))
    out = out.withColumn("_p", c("probability") if isinstance(model, OneVsRest) else vector_to_array("probability"))
    out = out.withColumns({p: F.coalesce(F.get("_p", F.lit(k)), F.lit(0.0)) for k, p in enumerate(P)})
    return out.select(*rows.columns, *P)


class OneVsRest:
    """Boosted trees for each class against the rest; the three probabilities are the softmax of their margins."""

    def __init__(self, sides: list):
        self.sides = sides

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a ``probability`` array."""
        kept = rows.columns
        for k, side in enumerate(self.sides):
            rows = side.transform(rows).withColumn(f"_m{k}", vector_to_array("rawPrediction")[1] * 2).select(*kept, *[f"_m{j}" for j in range(k + 1)])
        parts = [F.exp(f"_m{k}") for k in range(len(self.sides))]
        return rows.withColumn("probability", F.array(*[p / sum(parts[1:], parts[0]) for p in parts])).drop(*[f"_m{k}" for k in range(len(self.sides))])

    def save(self, path: str) -> None:
        for k, side in enumerate(self.sides):
            side.write().overwrite().save(f"{path}/class={k}")

    @staticmethod
    def load(path: str, classes: int = len(P)) -> OneVsRest:
        return OneVsRest([PipelineModel.load(f"{path}/class={k}") for k in range(classes)])


def train_boosted(rows: DataFrame, features: list[str], rounds: int = 20, depth: int = 4, seed: int = 42) -> OneVsRest:
    """Three-class boosting, one model a class, on balanced weights."""
    return OneVsRest([train_side(rows, features, k, rounds, depth, seed) for k in range(len(P))])


def calibrators(rows: DataFrame) -> list:
    """One isotonic regression per class against the rest."""
    return [IsotonicRegression(featuresCol=p, labelCol="_y").fit(rows.withColumn("_y", (c("label") == k).cast("double"))) for k, p in enumerate(P)]


def calibrated(models: list, rows: DataFrame) -> DataFrame:
    """``rows`` with calibrated probabilities that sum to one; scores outside the fitted range are clipped to it."""
    for k, (p, m) in enumerate(zip(P, models, strict=True)):
        rows = m.setPredictionCol(f"_q{k}").transform(rows)
    whole = F.greatest(sum((c(f"_q{k}") for k in range(len(P))), F.lit(0.0)), F.lit(1e-12))
    return rows.withColumns({p: c(f"_q{k}") / whole for k, p in enumerate(P)}).drop(*[f"_q{k}" for k in range(len(P))])


def out_of_time(rows: DataFrame, features: list[str], train_share: float = 0.6, fit_share: float = 0.2, purge: int = 48, trainer=train_boosted, cut: Callable[[DataFrame], DataFrame] = lambda df: df, **how) -> DataFrame:
    """(symbol, part, n, raw_log_loss, log_loss): a model and its calibration from a symbol's past, judged on its future.

    The first ``train_share`` of each symbol's bars (by ``bar``) fits the model, the next ``fit_share`` its calibration,
    the rest is the future; ``purge`` bars at each border are left out, as their labels look ahead.
    ``cut`` may store the rows (a function that writes a table and reads it back), so that they are computed once for all fits and scorings.
    """
    at = (c("bar") - 1) / F.max("bar").over(Window.partitionBy("symbol"))
    gap = F.lit(float(purge)) / F.max("bar").over(Window.partitionBy("symbol"))
    second = train_share + fit_share
    part = F.when(at < train_share, "train").when((at >= F.lit(train_share) + gap) & (at < second), "fit").when(at >= F.lit(second) + gap, "future")
    rows = cut(rows.where("label >= 0").withColumn("part", part).where("part is not null").select("symbol", "ts", "label", "part", *features))
    model = trainer(rows.where("part = 'train'"), features, **how)
    raw = cut(scored(model, rows.where("part <> 'train'"), features))
    sharp = calibrated(calibrators(raw.where("part = 'fit'")), raw.where("part = 'future'"))
    both = log_loss(raw.where("part = 'future'"), ["symbol"]).withColumnRenamed("log_loss", "raw_log_loss")
    return both.join(log_loss(sharp, ["symbol"]).drop("n"), "symbol").select("symbol", F.lit("future").alias("part"), "n", "raw_log_loss", "log_loss")


def importance(model, rows: DataFrame, features: list[str], seed: int = 0, block: int = 16, most: int | None = None) -> DataFrame:
    """(feature, importance): how much the log loss grows when a feature is dealt anew among the rows.

    Rows meet the row that is drawn for them once; then each is scored once per feature with that one value
    exchanged, ``block`` features at a time, and the losses are averaged by feature.  So a row is never there more than ``block`` times, however many features there are.
    ``most`` limits the rows to those of least seeded hash: an estimate, whose bound is this parameter; by default all count.
    """
    if most is not None:
        rows = rows.orderBy(F.xxhash64("symbol", "ts", F.lit(seed + 1)), "symbol", "ts").limit(most)
    base = log_loss(scored(model, rows, features)).first()[0]
    at, drawn = Window.partitionBy("symbol").orderBy("ts"), Window.partitionBy("symbol").orderBy(F.xxhash64("symbol", "ts", F.lit(seed)), "ts")
    right = rows.select(c("symbol").alias("_s"), F.struct(*features).alias("_v"), F.row_number().over(drawn).alias("_q"))
    mixed = rows.withColumn("_r", F.row_number().over(at)).join(right, (c("symbol") == c("_s")) & (c("_r") == c("_q")))
    out = None
    for k in range(0, len(features), block):
        part = features[k : k + block]
        each = mixed.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in part])))
        each = each.withColumns({f: F.when(c("feature") == f, c(f"_v.{f}")).otherwise(c(f)) for f in part}).drop("_s", "_v", "_q", "_r")
        found = log_loss(scored(model, each, features), ["feature"]).select("feature", (c("log_loss") - F.lit(float(base))).alias("importance"))
        out = found if out is None else out.unionByName(found)
    return out


def contributions(model, rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with contribution_<feature>: what each class-0 score changes when the feature is set to its median, row by row.

    A stand-in for tree path attributions that needs one pass and no access to the trees.
    """
    middle = rows.agg(*[F.percentile_approx(f, 0.5, F.lit(10_000)).alias(f) for f in features]).first()
    whole = scored(model, rows, features).withColumnRenamed("p0", "_whole")
    each = whole.drop(*P).withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    each = each.withColumns({f: F.when(c("feature") == f, F.lit(middle[f])).otherwise(c(f)) for f in features})
    each = scored(model, each, features).withColumn("contribution", c("_whole") - c("p0"))
    return each.groupBy("symbol", "ts").pivot("feature", features).agg(F.first("contribution")).withColumnsRenamed({f: f"contribution_{f}" for f in features})


def search(folds: list[tuple[DataFrame, DataFrame]], features: list[str], space: dict[str, list], trials: int = 10, seed: int = 0) -> list[tuple[dict, float]]:
    """Random search: parameters of ``train`` by mean log loss over folds; a trial worse than the median after a fold stops early."""
    every = [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]
    chosen = random.Random(seed).sample(every, min(trials, len(every)))
    firsts: list[float] = []
    done = []
    for params in chosen:
        losses = []
        for fit, val in folds:
            losses.append(float(log_loss(scored(train(fit, features, **params), val, features)).first()[0]))
            if len(losses) == 1:
                firsts.append(losses[0])
                if len(firsts) > 4 and losses[0] > sorted(firsts)[len(firsts) // 2]:
                    break
        if len(losses) == len(folds):
            done.append((params, sum(losses) / len(losses)))
    return sorted(done, key=lambda x: x[1])
