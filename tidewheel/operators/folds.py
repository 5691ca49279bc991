"""Walk-forward folds in calendar months with a purged gap, and the ordered split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.exprs import KEY, TIME, W

c = F.col


def walk_forward(bars: DataFrame, train: int, val: int, step: int, purge: int) -> DataFrame:
    """(symbol, fold, train_start, train_end, val_start, val_end): half-open ranges, as long as the last one ends within the data.

    The gap is ``purge`` times the median distance of bars.
    """
    apart = F.unix_timestamp(c(TIME).cast("timestamp")) - F.unix_timestamp(F.lag(TIME).over(W()).cast("timestamp"))
    span = bars.select(KEY, TIME, apart.alias("s")).groupBy(KEY).agg(F.min(TIME).alias("lo"), F.max(TIME).alias("hi"), F.median("s").cast("long").alias("gap"))
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.months_between("hi", "lo") / step).cast("int"), F.lit(0)))
    rows = span.select("*", F.explode(steps).alias("fold"))
    months = lambda at, n: f"cast({at} + make_interval(0, {n}) as timestamp_ntz)"
    rows = rows.withColumn("train_start", F.expr(months("lo", f"fold * {step}")))
    rows = rows.withColumn("train_end", F.expr(months("train_start", train)))
    rows = rows.withColumn("val_start", F.expr(f"cast(train_end + make_dt_interval(0, 0, 0, gap * {purge}) as timestamp_ntz)"))
    rows = rows.withColumn("val_end", F.expr(months("val_start", val)))
    return rows.where("val_end <= hi").select(KEY, "fold", "train_start", "train_end", "val_start", "val_end")


def in_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row once for every fold it belongs to, with ``part`` train or val. Folds are a handful of rows per symbol."""
    t = c(TIME)
    part = F.when((t >= c("train_start")) & (t < c("train_end")), "train").when((t >= c("val_start")) & (t < c("val_end")), "val")
    return rows.join(folds, KEY).withColumn("part", part).where("part is not null").drop("train_start", "train_end", "val_start", "val_end")


def ordered_split(rows: DataFrame, share: float, purge: int) -> DataFrame:
    """``rows`` with ``part``: the first share is train, then ``purge`` bars belong to neither, the rest is val."""
    n = F.floor(F.count("*").over(Window.partitionBy(KEY)) * share)
    rows = rows.withColumns({"_i": F.row_number().over(W()) - 1, "_cut": n})
    part = F.when(c("_i") < c("_cut"), "train").when(c("_i") >= c("_cut") + purge, "val")
    return rows.withColumn("part", part).drop("_i", "_cut")
