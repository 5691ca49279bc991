"""Attributions of tree models: what each feature adds to each row's margin, exactly, along the paths of the fitted trees.

The trees are small (a few thousand nodes) and go to the tasks as arrays; rows stay where they are.  A leaf's share of a feature is
the Shapley value of the game in which a present feature follows the row and an absent one is averaged by the training rows on either side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.model import OneVsRest, vectors

c = F.col


@dataclass
class Leaf:
    """A leaf as the box that its path cuts out: for each feature on the path, above ``low`` and up to ``high``, and the share of training rows that stay on the path at its splits."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaves(tree) -> list[Leaf]:
    """The leaves of a fitted tree of continuous features."""
    out: list[Leaf] = []
    todo = [(tree._call_java("rootNode"), {})]
    while todo:
        node, path = todo.pop()
        if node.subtreeDepth() == 0:
            names = sorted(path)
            low, high, share = (np.array([path[f][k] for f in names], float) for k in range(3))
            out.append(Leaf(node.prediction(), np.array(names, int), low, high, share))
            continue
        split, whole = node.split(), node.impurityStats().count()
        f, at = split.featureIndex(), split.threshold()
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, box in ((node.leftChild(), (low, min(high, at))), (node.rightChild(), (max(low, at), high))):
            todo.append((child, path | {f: (*box, share * child.impurityStats().count() / whole)}))
    return out


def weights(m: int) -> np.ndarray:
    """The weight of a coalition of k of the m - 1 other features."""
    return np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])


def shared_out(x: np.ndarray, found: list[Leaf]) -> np.ndarray:
    """The attributions of one tree for the rows of ``x``."""
    out = np.zeros_like(x)
    for leaf in found:
        m = len(leaf.features)
        if not m:
            continue
        on = (x[:, leaf.features] > leaf.low) & (x[:, leaf.features] <= leaf.high)
        w = weights(m)
        for i, f in enumerate(leaf.features):
            # Sums over coalitions of the others by size: the coefficients of a product of (share + on * t).
            sizes = np.zeros((len(x), m))
            sizes[:, 0] = 1.0
            for j in range(m):
                if j != i:
                    sizes[:, 1:] = sizes[:, 1:] * leaf.share[j] + sizes[:, :-1] * on[:, [j]]
                    sizes[:, 0] *= leaf.share[j]
            out[:, f] += leaf.value * (on[:, i] - leaf.share[i]) * (sizes @ w)
    return out


def expected(found: list[Leaf]) -> float:
    """The mean of a tree over its training rows."""
    return float(sum(leaf.value * np.prod(leaf.share) for leaf in found))


def attributions(model, rows: DataFrame, features: list[str]) -> DataFrame:
    """(symbol, ts, class, base, margin, shares) for each row and each class of a boosted model; ``shares`` has a value a feature, and base plus their sum is the margin.

    For a one-sided model there is one class.  Gaps are filled as the model fills them.  Rows are scored once a class, in Arrow batches.
    """
    sides = model.sides if isinstance(model, OneVsRest) else [model]
    trees, bases, scales = [], [], []
    for side in sides:
        made = side.stages[-1]
        found = [(w, leaves(t)) for w, t in zip(made.treeWeights, made.trees, strict=True)]
        scale = 2.0  # margins are log odds, twice the sum of the trees
        trees.append(found)
        scales.append(scale)
        bases.append(scale * sum(w * expected(x) for w, x in found))
    filler = sides[0].stages[: len(vectors(features))]
    ready = rows.withColumns({f: c(f).cast("double") for f in features})
    for stage in filler:
        ready = stage.transform(ready)
    ready = ready.select("symbol", "ts", vector_to_array("features").alias("x"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            if not len(b):
                continue
            x = np.array(b["x"].tolist(), float)
            for k, found in enumerate(trees):
                parts = scales[k] * sum((w * shared_out(x, leaf) for w, leaf in found), np.zeros_like(x))
                yield pd.DataFrame({"symbol": b["symbol"], "ts": b["ts"], "class": k, "base": bases[k], "margin": bases[k] + parts.sum(1), "shares": list(parts)})

    kinds = dict(ready.dtypes)
    return ready.mapInPandas(run, f"symbol {kinds['symbol']}, ts {kinds['ts']}, class int, base double, margin double, shares array<double>")


def ranked(shares: DataFrame, features: list[str]) -> DataFrame:
    """(class, rank, feature, mean_abs, std_abs, share, cum_share): features by the size of what they add, for each class."""
    from pyspark.sql import Window

    each = shares.select("class", F.posexplode("shares").alias("k", "v"))
    by = each.groupBy("class", "k").agg(F.avg(F.abs("v")).alias("mean_abs"), F.stddev_pop(F.abs("v")).alias("std_abs"))
    whole = Window.partitionBy("class")
    by = by.withColumns({"feature": F.element_at(F.array(*[F.lit(f) for f in features]), c("k") + 1), "share": F.try_divide("mean_abs", F.sum("mean_abs").over(whole))})
    order = whole.orderBy(F.desc("mean_abs"), "feature")
    return by.select("class", F.row_number().over(order).alias("rank"), "feature", "mean_abs", "std_abs", "share", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_share"))
