"""Bars: building them from ticks, resampling, latest-wins merging, joining a higher timeframe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.exprs import KEY, TIME, W

OHLCV = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def from_ticks(ticks: DataFrame, symbol: Column, ts: Column, price: Column, size: Column, order: list[Column], unit: str = "hour") -> DataFrame:
    """Open, high, low, close and volume per symbol and time unit.

    One aggregation: open and close are the prices at the least and greatest
    ``order``, which has to be total for a fixed result.
    """
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rows = ticks.select(symbol.alias(KEY), F.date_trunc(unit, ts).cast("timestamp_ntz").alias(TIME), price.cast("double").alias("p"), size.cast("double").alias("v"), at.alias("at"))
    return rows.groupBy(KEY, TIME).agg(
        F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.sum("v").alias("volume")
    )


def resampled(bars: DataFrame, unit: str = "day") -> DataFrame:
    """Bars of a coarser unit: day, week (from Monday), hour and so on."""
    when = F.date_trunc(unit, F.col(TIME)).cast("timestamp_ntz")
    return bars.groupBy(KEY, when.alias("period")).agg(
        F.min_by("open", TIME).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", TIME).alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("period", TIME)


def latest_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by ``order``. This is what an upsert leaves."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` doesn't have, one per key: insert or do nothing."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def closed_only(bars: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Bars whose time unit has ended at ``now``."""
    return bars.where(F.unix_timestamp(F.col(TIME).cast("timestamp")) + seconds <= F.unix_timestamp(now))


def watermarks(bars: DataFrame) -> DataFrame:
    """The time up to which each symbol is there: where a resumed load goes on."""
    return bars.groupBy(KEY).agg(F.max(TIME).alias("last_ts"), F.count("*").alias("bars"))


def gaps(bars: DataFrame, seconds: int) -> DataFrame:
    """Runs of missing bars: the bar before, the bar after and how many are missing."""
    before = F.lag(TIME).over(W())
    apart = F.unix_timestamp(F.col(TIME).cast("timestamp")) - F.unix_timestamp(before.cast("timestamp"))
    return bars.select(KEY, before.alias("after_ts"), F.col(TIME).alias("before_ts"), (apart / seconds - 1).cast("long").alias("missing")).where("missing > 0")


def previous_higher(bars: DataFrame, higher: DataFrame, columns: list[str], unit: str) -> DataFrame:
    """``bars`` with columns of the bar of a coarser unit before the running one.

    The higher frame is shifted by one row and then met by equality on the
    unit's start, so nothing of an unfinished bar is seen.
    """
    shifted = higher.select(F.col(KEY).alias("_k"), F.col(TIME).alias("_t"), *[F.lag(c).over(W()).alias(c) for c in columns])
    at = F.date_trunc(unit, F.col(TIME)).cast("timestamp_ntz")
    return bars.join(shifted, (F.col(KEY) == F.col("_k")) & (at == F.col("_t")), "left").drop("_k", "_t")


def resumed(source: DataFrame, stored: DataFrame) -> DataFrame:
    """What of a source is newer than each symbol's last stored bar; symbols without any come whole.

    The watermarks are one row a symbol; stored bars are only read for their maximum.
    """
    last = watermarks(stored).select(F.col(KEY).alias("_s"), F.col("last_ts").alias("_last"))
    rows = source.join(last, F.col(KEY) == F.col("_s"), "left")
    return rows.where(F.col("_last").isNull() | (F.col(TIME) > F.col("_last"))).drop("_s", "_last")


def caught_up(bars: DataFrame, source: DataFrame, seconds: int) -> DataFrame:
    """``bars`` with what a source has for their gaps. A gap and the source meet by symbol and time range."""
    holes = gaps(bars, seconds).select(F.col(KEY).alias("_s"), "after_ts", "before_ts")
    rows = source.join(holes, (F.col(KEY) == F.col("_s")) & (F.col(TIME) > F.col("after_ts")) & (F.col(TIME) < F.col("before_ts")), "left_semi")
    return bars.unionByName(rows.select(*bars.columns))


def with_tape(bars: DataFrame, tape: DataFrame, names: list[str]) -> DataFrame:
    """``bars`` with columns of another table of (symbol, ts), as they stood at the bar before: what a bar may know when it opens."""
    order = Window.partitionBy(KEY).orderBy(TIME)
    before = bars.withColumn("_p", F.lag(TIME).over(order))
    right = tape.select(F.col(KEY).alias("_s"), F.col(TIME).alias("_t"), *names)
    return before.join(right, (F.col(KEY) == F.col("_s")) & (F.col("_p") == F.col("_t")), "left").drop("_s", "_t", "_p")


def as_of(rows: DataFrame, right: DataFrame, names: list[str], tolerance: int | None = None, part: str = "month", at: str | None = None) -> DataFrame:
    """``rows`` of (symbol, ts) with the columns of the last row of ``right`` (symbol, ts) at or before them, null if it is more than ``tolerance`` seconds older.

    Both sides are laid together and the last value is carried on, in windows of a symbol and a ``part`` of time, so a long
    history is many tasks; what a part starts with is the last value of the parts before, of which there are few.  Of rows of ``right`` at one
    time the greatest counts.  Rows without a time or a symbol get nulls.  ``at`` names a column for the time of the row that was met.
    """
    names_ = [f"_v{k}" for k in range(len(names))]
    value = F.struct(F.col(TIME).alias("_at"), *[F.col(n).alias(v) for n, v in zip(names, names_, strict=True)])
    slot = lambda t: F.date_trunc(part, t).cast("timestamp_ntz")
    known = right.where(F.col(KEY).isNotNull() & F.col(TIME).isNotNull()).groupBy(KEY, TIME).agg(F.max(value).alias("_value"))
    known = known.select(F.col(KEY).alias("_s"), F.col(TIME).alias("_t"), "_value")
    left = rows.select(F.struct(*rows.columns).alias("_row"), F.col(KEY).alias("_s"), F.col(TIME).alias("_t"))
    both = left.unionByName(known, allowMissingColumns=True).withColumn("_slot", slot(F.col("_t")))
    # A value of the same time comes before the row.
    order = Window.partitionBy("_s", "_slot").orderBy("_t", F.col("_value").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_value", ignorenulls=True).over(order)).where("_row is not null")
    ends = known.groupBy("_s", slot(F.col("_t")).alias("_slot")).agg(F.max_by("_value", "_t").alias("_end"))
    needed = left.select("_s", slot(F.col("_t")).alias("_slot")).distinct()
    carried = needed.join(ends, ["_s", "_slot"], "full_outer").withColumn("_before", F.last("_end", ignorenulls=True).over(Window.partitionBy("_s").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)))
    carried = carried.where("_before is not null").select(F.col("_s").alias("_cs"), F.col("_slot").alias("_cslot"), "_before")
    met = both.join(carried, (F.col("_s") == F.col("_cs")) & (F.col("_slot") == F.col("_cslot")), "left").withColumn("_met", F.coalesce("_last", "_before"))
    if tolerance is not None:
        seconds = lambda x: F.unix_micros(F.col(x).cast("timestamp")) / 1_000_000
        met = met.withColumn("_met", F.when(seconds("_t") - seconds("_met._at") <= tolerance, F.col("_met")))
    return met.select("_row.*", *[F.col(f"_met.{v}").alias(n) for n, v in zip(names, names_, strict=True)], *([F.col("_met._at").alias(at)] if at else []))
