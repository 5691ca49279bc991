"""Evaluation of class probabilities (p0, p1, p2) against labels, all as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
P = ("p0", "p1", "p2")
#: Probabilities at which signals are looked at.
THRESHOLDS = (0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75)


def predicted(rows: DataFrame) -> DataFrame:
    """``rows`` with max_p and pred; the first class wins ties."""
    p = F.array(*P)
    return rows.withColumns({"max_p": F.array_max(p), "pred": (F.array_position(p, F.array_max(p)) - 1).cast("int")})


def probability_of_label() -> Column:
    return F.element_at(F.array(*P), c("label") + 1)


def log_loss(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    clipped = F.greatest(F.least(probability_of_label(), F.lit(1 - 1e-15)), F.lit(1e-15))
    return rows.groupBy(*(by or [])).agg(F.avg(-F.ln(clipped)).alias("log_loss"), F.count("*").alias("n"))


def brier(rows: DataFrame) -> DataFrame:
    """(class, brier) for each class against the rest."""
    one = [F.avg(F.pow(c(p) - (c("label") == k).cast("double"), F.lit(2.0))).alias(f"b{k}") for k, p in enumerate(P)]
    wide = rows.agg(*one)
    return wide.select(F.posexplode(F.array(*[f"b{k}" for k in range(len(P))])).alias("class", "brier"))


def confusion(rows: DataFrame) -> DataFrame:
    """(label, pred, n) for all nine pairs, zeros too."""
    n = predicted(rows).groupBy("label", "pred").agg(F.count("*").alias("k"))
    pairs = rows.sparkSession.range(9).select((c("id") / 3).cast("int").alias("label"), (c("id") % 3).cast("int").alias("pred"))
    return pairs.join(n, ["label", "pred"], "left").select("label", "pred", F.coalesce("k", F.lit(0)).alias("n"))


def per_class(rows: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support); 0 where there is nothing to divide by."""
    m = confusion(rows)
    hit = F.sum(F.when(c("label") == c("pred"), c("n")).otherwise(0))
    by_label = m.groupBy(c("label").alias("class")).agg(hit.alias("hit"), F.sum("n").alias("support"))
    by_pred = m.groupBy(c("pred").alias("class")).agg(F.sum("n").alias("said"))
    both = by_label.join(by_pred, "class")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    both = both.withColumns({"precision": zero(F.try_divide("hit", "said")), "recall": zero(F.try_divide("hit", "support"))})
    return both.withColumn("f1", zero(F.try_divide(2 * c("precision") * c("recall"), c("precision") + c("recall")))).select("class", "precision", "recall", "f1", "support")


def threshold_sweep(rows: DataFrame, by: list[str] | None = None, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Per threshold (and group): how often signals fire and hit, per side too. Each row is exploded over the thresholds it reaches within one stage."""
    rows = predicted(rows).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    fire, aimed, hit = c("max_p") >= c("threshold"), c("pred") != 2, c("pred") == c("label")
    share = lambda x: F.avg(x.cast("double"))
    side = lambda k: (fire & (c("pred") == k))
    return rows.groupBy(*(by or []), "threshold").agg(
        F.count_if(fire).alias("fire_count"), share(fire).alias("fire_rate"), F.count_if(fire & aimed).alias("dir_fire_count"), share(fire & aimed).alias("dir_fire_rate"),
        F.avg(F.when(fire & aimed, hit.cast("double"))).alias("dir_hit_rate"),
        F.count_if(side(0)).alias("long_fire_count"), F.avg(F.when(side(0), hit.cast("double"))).alias("long_hit_rate"),
        F.count_if(side(1)).alias("short_fire_count"), F.avg(F.when(side(1), hit.cast("double"))).alias("short_hit_rate"),
    )


def pooled(sweep: DataFrame) -> DataFrame:
    """Hit rates over all groups of a sweep: sums of hits over sums of signals."""
    hits = lambda s: F.try_divide(F.sum(F.coalesce(c(f"{s}_hit_rate") * c(f"{s}_fire_count"), F.lit(0.0))), F.sum(f"{s}_fire_count"))
    return sweep.groupBy("threshold").agg(F.avg("fire_rate").alias("fire_rate"), *[x for s in ("long", "short") for x in (F.sum(f"{s}_fire_count").alias(f"{s}_n"), hits(s).alias(f"{s}_hit_rate"))])


def auc(rows: DataFrame, score: str, positive: Column, ranges: int = 4096) -> DataFrame:
    """Area under the ROC curve by rank sums; tied scores share their mean rank. Scores are probabilities.

    Equal scores are counted first; then each of ``ranges`` equal ranges of scores is ranked by itself, and only
    the ranges' sums are ranked over all, so no task holds all different scores.
    """
    n = rows.groupBy(c(score).alias("s")).agg(F.count("*").alias("k"), F.count_if(positive).alias("p"))
    n = n.withColumn("range", F.floor(F.least(F.greatest(c("s"), F.lit(0.0)), F.lit(1.0)) * ranges))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = n.groupBy("range").agg(F.sum("k").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before(Window.orderBy("range"))), F.lit(0)))
    n = n.join(sums.select("range", "offset"), "range")
    inside = F.coalesce(F.sum("k").over(before(Window.partitionBy("range").orderBy("s"))), F.lit(0))
    n = n.withColumn("rank", c("offset") + inside + (c("k") + 1) / F.lit(2.0))
    total = n.agg(F.sum(c("rank") * c("p")).alias("r"), F.sum("p").alias("np"), F.sum(c("k") - c("p")).alias("nn"))
    return total.select(F.try_divide(c("r") - c("np") * (c("np") + 1) / 2, c("np") * c("nn")).alias("auc"), c("np").alias("positives"), c("nn").alias("negatives"))


def prior_entropy(rows: DataFrame) -> DataFrame:
    """Log loss of always saying the label shares."""
    n = rows.groupBy("label").agg(F.count("*").alias("k"))
    p = c("k") / F.sum("k").over(Window.partitionBy(F.lit(0)))
    return n.select("label", p.alias("p")).agg(F.sum(-c("p") * F.ln("p")).alias("prior_entropy"))


def coverage(importance: DataFrame, share: float = 0.95, least: int = 80, most: int = 150) -> DataFrame:
    """The features that together cover a share of all importance: their number is kept within bounds."""
    order = Window.orderBy(c("importance").desc(), "feature")
    rows = importance.withColumns({"rank": F.row_number().over(order), "share": c("importance") / F.sum("importance").over(Window.partitionBy(F.lit(0)))})
    rows = rows.withColumn("cum_share", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(F.lit(0))
    reached = F.coalesce(F.min(F.when(c("cum_share") >= share, c("rank"))).over(whole), F.count("*").over(whole))
    rows = rows.withColumn("_n", F.greatest(F.lit(least), F.least(F.lit(most), reached)))
    return rows.where("rank <= _n").drop("_n")


def shuffled_labels(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Labels dealt anew among the rows of a symbol by a seeded hash: two orders joined on their rank."""
    at = Window.partitionBy("symbol").orderBy("ts")
    drawn = Window.partitionBy("symbol").orderBy(F.xxhash64("symbol", "ts", F.lit(seed)), "ts")
    left = rows.drop("label").withColumn("_r", F.row_number().over(at))
    right = rows.select(c("symbol").alias("_s"), "label", F.row_number().over(drawn).alias("_q"))
    return left.join(right, (c("symbol") == c("_s")) & (c("_r") == c("_q"))).drop("_s", "_r", "_q")


def seeded_sample(rows: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """n rows of least seeded hash."""
    return rows.withColumn("_h", F.xxhash64(*key, F.lit(seed))).orderBy("_h", *key).limit(n).drop("_h")
