"""Walk-forward training: folds that are stored once, rounds that stop early, predictions stacked over folds, and a study of parameters."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.exprs import KEY, TIME
from tidewheel.operators.evaluate import P, log_loss
from tidewheel.operators.folds import in_folds
from tidewheel.operators.model import OneVsRest, scored, vectors

c = F.col


def stored_folds(rows: DataFrame, folds: DataFrame, features: list[str], path: str, held: float = 0.15) -> DataFrame:
    """The rows of every fold with their part (train, stop or val), written below ``path`` by fold and part and read back.

    Rows and their features are computed once, whatever is trained on them, and a fold reads its own files.  The last ``held`` of each symbol's training
    rows say when to stop; with 0 the validation rows do.  Rows without a label are left out.
    """
    at = F.percent_rank().over(Window.partitionBy(KEY, "fold", "part").orderBy(TIME))
    made = in_folds(rows.where("label >= 0").select(KEY, TIME, c("label").cast("int").alias("label"), *[c(f).cast("double").alias(f) for f in features]), folds)
    made = made.withColumn("part", F.when((c("part") == "train") & (at > 1 - held), "stop").otherwise(c("part")))
    made.repartition("fold", "part").sortWithinPartitions(KEY, TIME).write.partitionBy("fold", "part").mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def boosted(fit: DataFrame, stop: DataFrame, features: list[str], rounds: int = 50, depth: int = 4, rate: float = 0.1, gain: float = 0.01, seed: int = 42) -> OneVsRest:
    """Three-class boosting on ``fit``; each class stops once a round lowers the loss on ``stop`` by less than ``gain`` of it.

    Both parts need some rows of a class and of the others; a class for which that fails is trained all rounds.
    """
    both = fit.withColumn("_stop", F.lit(False)).unionByName(stop.withColumn("_stop", F.lit(True)))
    counts = {(r["_stop"], r["label"]): r["n"] for r in both.groupBy("_stop", "label").agg(F.count("*").alias("n")).collect()}
    sides = []
    for k in range(len(P)):
        n, yes = sum(v for (late, _), v in counts.items() if not late), counts.get((False, k), 0)
        weighted = both.withColumn("y", (c("label") == k).cast("double")).withColumn("weight", F.when(c("y") == 1, (n - yes) / max(1, yes)).otherwise(1.0))
        trees = GBTClassifier(labelCol="y", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)
        late = sum(v for (held, _), v in counts.items() if held)
        if 0 < counts.get((True, k), 0) < late:
            trees = trees.setValidationIndicatorCol("_stop")
        else:
            weighted = weighted.where("not _stop")
        sides.append(Pipeline(stages=[*vectors(features), trees]).fit(weighted))
    return OneVsRest(sides)


@dataclass
class WalkForward:
    """What training over folds leaves: stacked predictions, and for each fold the model and the rounds of each class."""

    predictions: DataFrame
    models: dict[int, OneVsRest]
    rounds: dict[int, list[int]]

    def report(self) -> DataFrame:
        """(fold, n, rounds, log_loss, accuracy, prior_log_loss) of each fold; the prior is the fold's own share of each class."""
        best = F.array_position(F.array(*P), F.greatest(*P)) - 1
        by = log_loss(self.predictions, ["fold"]).join(self.predictions.groupBy("fold").agg(F.avg((best == c("label")).cast("double")).alias("accuracy"), *[F.avg((c("label") == k).cast("double")).alias(f"_s{k}") for k in range(len(P))]), "fold")
        prior = -sum((F.when(c(f"_s{k}") > 0, c(f"_s{k}") * F.log(f"_s{k}")).otherwise(0.0) for k in range(len(P))), F.lit(0.0))
        used = F.create_map(*[x for k, r in self.rounds.items() for x in (F.lit(k), F.lit(max(r)))]) if self.rounds else F.lit(None)
        return by.select("fold", "n", used[c("fold")].alias("rounds") if self.rounds else used.cast("int").alias("rounds"), "log_loss", "accuracy", prior.alias("prior_log_loss"))


def walk_forward(table: DataFrame, features: list[str], held: float = 0.15, **how) -> WalkForward:
    """Trains on each fold of a table from ``stored_folds`` (made with the same ``held``) and predicts its validation rows, which no fold's model has seen.

    The driver goes over the folds, of which there are a handful; rows stay in Spark.  Predictions of all folds are one table (symbol, ts, fold, label, p0, p1, p2).
    """
    stacked, models, rounds = None, {}, {}
    for k in sorted(r["fold"] for r in table.select("fold").distinct().collect()):
        own = table.where(c("fold") == k)
        part = lambda name: own.where(c("part") == name).drop("fold", "part")  # noqa: B023, E731
        models[k] = boosted(part("train"), part("stop" if held else "val"), features, **how)
        rounds[k] = [len(s.stages[-1].treeWeights) for s in models[k].sides]
        found = scored(models[k], part("val"), features).select(KEY, TIME, F.lit(k).alias("fold"), "label", *P)
        stacked = found if stacked is None else stacked.unionByName(found)
    if stacked is None:
        raise ValueError("no fold: the bars are too short for the training and validation months")
    return WalkForward(stacked, models, rounds)


@dataclass
class Trial:
    """One choice of parameters: its losses so far by step, and its value once it has ended."""

    params: dict
    steps: list[float] = field(default_factory=list)
    value: float | None = None
    pruned: bool = False


class Pruned(Exception):
    """A trial that has fallen behind."""


class Study:
    """Sequential search by tree-structured Parzen estimators, with median pruning.

    After ``startup`` random trials, parameters are drawn where good trials are dense and others are not: of ``draws``
    values from the density of the best quarter, the one with the greatest ratio of the two densities.  The same seed gives the same study.

    ``space`` has for each name a list of choices, or (low, high) of whole numbers or of doubles, or (low, high, "log").
    """

    def __init__(self, space: dict[str, list | tuple], seed: int = 0, startup: int = 8, share: float = 0.25, draws: int = 24, warm: int = 4):
        self.space, self.rng = space, random.Random(seed)
        self.startup, self.share, self.draws, self.warm = startup, share, draws, warm
        self.trials: list[Trial] = []

    def _line(self, name: str) -> tuple[float, float, bool, bool]:
        low, high, *kind = self.space[name]
        log = kind == ["log"]
        return (math.log(low) if log else low), (math.log(high) if log else high), log, isinstance(low, int) and isinstance(high, int)

    def _random(self, name: str):
        spec = self.space[name]
        if isinstance(spec, list):
            return self.rng.choice(spec)
        low, high, _, whole = self._line(name)
        return self._value(name, self.rng.uniform(low - 0.5 * whole, high + 0.5 * whole))

    def _value(self, name: str, at: float):
        low, high, log, whole = self._line(name)
        at = math.exp(min(max(at, low), high)) if log else min(max(at, low), high)
        return round(at) if whole else at

    @staticmethod
    def _density(at: float, known: list[float], low: float, high: float) -> float:
        """A flat prior and a bell around each known value, each as wide as the values are apart."""
        width = max((high - low) / (1 + len(known)), 1e-12)
        bells = sum(math.exp(-0.5 * ((at - k) / width) ** 2) / (width * math.sqrt(2 * math.pi)) for k in known)
        return (1 / max(high - low, 1e-12) + bells) / (1 + len(known))

    def suggest(self) -> dict:
        """The parameters of the next trial."""
        ended = sorted((t for t in self.trials if t.steps or t.value is not None), key=lambda t: t.value if t.value is not None else math.inf)
        if len(ended) < self.startup:
            return {n: self._random(n) for n in self.space}
        cut = max(2, math.ceil(self.share * len(ended)))
        good, rest = ended[:cut], ended[cut:]
        out = {}
        for n, spec in self.space.items():
            if isinstance(spec, list):
                odds = lambda v, n=n, spec=spec: ((sum(t.params[n] == v for t in good) + 1) / (len(good) + len(spec))) / ((sum(t.params[n] == v for t in rest) + 1) / (len(rest) + len(spec)))
                weights = [sum(t.params[n] == v for t in good) + 1 for v in spec]
                out[n] = max(self.rng.choices(spec, weights, k=self.draws), key=odds)
                continue
            low, high, log, _ = self._line(n)
            places = [[math.log(t.params[n]) if log else float(t.params[n]) for t in group] for group in (good, rest)]
            width = (high - low) / (1 + len(good))
            drawn = [min(max(self.rng.gauss(self.rng.choice(places[0]), width), low), high) for _ in range(self.draws - 1)] + [self.rng.uniform(low, high)]
            out[n] = self._value(n, max(drawn, key=lambda v: self._density(v, places[0], low, high) / self._density(v, places[1], low, high)))  # noqa: B023
        return out

    def report(self, trial: Trial, loss: float) -> None:
        """Notes a trial's loss after its next step; a trial worse than the median of the earlier ones at that step is ended."""
        trial.steps.append(loss)
        k = len(trial.steps)
        others = sorted(t.steps[k - 1] for t in self.trials if t is not trial and len(t.steps) >= k)
        if len(others) >= self.warm and loss > others[len(others) // 2]:
            raise Pruned

    def run(self, objective: Callable[[dict, Callable[[float], None]], float], trials: int) -> Trial:
        """The best of ``trials`` more trials of ``objective(params, report)``, which is to be least."""
        for _ in range(trials):
            trial = Trial(self.suggest())
            self.trials.append(trial)
            try:
                trial.value = float(objective(trial.params, lambda loss, t=trial: self.report(t, float(loss))))
            except Pruned:
                trial.pruned = True
        return min((t for t in self.trials if t.value is not None), key=lambda t: t.value)


def tuned(table: DataFrame, features: list[str], space: dict[str, list | tuple], trials: int = 20, seed: int = 0, folds: list[int] | None = None, held: float = 0.15) -> Study:
    """A study of the parameters of ``boosted`` by the mean log loss over folds of a stored table; after each fold the mean so far is reported."""
    numbers = sorted(folds if folds is not None else (r["fold"] for r in table.select("fold").distinct().collect()))

    def objective(params: dict, report: Callable[[float], None]) -> float:
        losses: list[float] = []
        for k in numbers:
            made = walk_forward(table.where(c("fold") == k), features, held, **params)
            losses.append(float(log_loss(made.predictions).first()["log_loss"]))
            report(sum(losses) / len(losses))
        return sum(losses) / len(losses)

    study = Study(space, seed)
    study.run(objective, trials)
    return study
