"""Fibonacci pivots of the day and week, sessions, and what the day before left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.exprs import KEY, TIME, W, diff, flag, lag, percent, percent_rank, ratio, sign
from tidewheel.features.volatility import day_window
from tidewheel.operators.bars import resampled
from tidewheel.plans.config import Config

c = F.col
#: Multiples of the range, from the lowest level to the highest.
LEVELS = {"S3": -1.0, "S2": -0.618, "S1": -0.382, "P": 0.0, "R1": 0.382, "R2": 0.618, "R3": 1.0}
#: Hours (UTC) at which a session opens and closes.
SESSIONS = {"sydney": (21, 6), "tokyo": (0, 9), "london": (7, 16), "new_york": (13, 22)}


def of_period(df: DataFrame, higher: DataFrame, unit: str) -> DataFrame:
    """``df`` joined on the period that each bar is in; ``higher`` has one row per period, a small side that Spark may broadcast."""
    at = F.date_trunc(unit, F.col(TIME)).cast("timestamp_ntz")
    higher = higher.withColumnsRenamed({KEY: "_k", TIME: "_t"})
    return df.join(higher, (F.col(KEY) == F.col("_k")) & (at == F.col("_t")), "left").drop("_k", "_t")


def pivots(df: DataFrame, g: Config, unit: str = "day") -> DataFrame:
    """Levels from the period before, and where the close stands among them.

    On the first period there are no levels: the nearest is then 0, the zone -1 and nothing is touched.
    """
    week = unit == "week"
    pre, near, tested = ("weekly_", "_weekly", "weekly_pivot_times_tested_this_week") if week else ("", "", "pivot_times_tested_today")
    before = lambda x: F.lag(x).over(W())
    span, middle = before("high") - before("low"), (before("high") + before("low") + before("close")) / 3
    names = [f"{pre}pivot_{k}" for k in LEVELS]
    higher = resampled(df.select(KEY, TIME, "open", "high", "low", "close", "volume"), unit)
    higher = higher.select(KEY, TIME, *[(middle + F.lit(m) * span).alias(n) for n, m in zip(names, LEVELS.values(), strict=True)])
    df = of_period(df, higher, unit)
    levels = F.array(*names)
    far = F.transform(levels, lambda x: F.abs(x - c("close")))
    df = df.withColumn("_n", F.coalesce(F.array_position(far, F.array_min(far)), F.lit(1)).cast("int"))
    df = df.withColumn("_level", F.element_at(levels, c("_n")))
    zone = F.when(c(names[0]).isNull(), -1.0).when(c("close") <= c(names[0]), 0.0).when(c("close") >= c(names[-1]), 5.0)
    inside = F.size(F.filter(levels, lambda x: x <= c("close"))) - 1
    df = df.withColumn("_off", c("close") - c("_level"))
    closer = F.coalesce(F.abs("_off") < F.abs(lag("_off")), F.lit(False))
    start = F.date_trunc(unit, c(TIME))
    so_far = Window.partitionBy(KEY, start).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    touched = flag(F.abs("_off") <= c("_level") * g.touch_percent / 100)
    return df.withColumns({
        f"dist_to_nearest{near}_pivot_pct": percent(F.abs("_off"), "close"), f"nearest{near}_pivot_type": c("_n") - 1, f"{pre}pivot_zone": zone.otherwise(inside.cast("double")),
        f"{pre}pivot_approach_dir": F.when(closer, F.when(c("_off") > 0, 1).otherwise(-1)).otherwise(0),
        f"{pre}pivot_approach_speed": percent(F.abs(diff("close", 3)), "close"), tested: F.sum(touched).over(so_far),
    })


def in_session(hour: Column, opens: int, closes: int) -> Column:
    return flag(hour.between(opens, closes - 1) if opens < closes else (hour >= opens) | (hour < closes))


def sessions(df: DataFrame, g: Config) -> DataFrame:
    """Which markets are open, how long the latest has been, and the day's range against the last twenty."""
    ts = c(TIME)
    hour, minute = F.hour(ts), F.hour(ts) * 60 + F.minute(ts)
    on = {k: in_session(hour, *v) for k, v in SESSIONS.items()}
    opened = F.when(hour >= 21, 21).when(hour >= 13, 13).when(hour >= 7, 7).otherwise(0)
    closes = F.when(hour >= 21, 30).when(hour >= 13, 22).when(hour >= 7, 16).otherwise(9)  # 6 o'clock of the next day is 30
    both = lambda a, b: flag(hour.between(a, b))
    daily = resampled(df.select(KEY, TIME, "open", "high", "low", "close", "volume"), "day")
    daily = daily.withColumns({"_range": c("high") - c("low"), "_pct": percent(c("high") - c("low"), "open")})
    last20 = W().rowsBetween(-20, -1)
    daily = daily.select(KEY, TIME, F.when(F.count("_range").over(last20) == 20, F.avg("_range").over(last20)).alias("_avg20"), F.lag("_pct").over(W()).alias("prev_session_range_pct"))
    df = of_period(df, daily, "day")
    day = day_window(g.causal)
    return df.withColumns({f"session_{k}": v for k, v in on.items()} | {
        "overlap_tokyo_london": both(7, 8), "overlap_london_ny": both(13, 15), "overlap_ny_sydney": both(21, 21), "overlap_sydney_tokyo": both(0, 5),
        "active_session_count": on["sydney"] + on["tokyo"] + on["london"] + on["new_york"], "minutes_into_session": minute - opened * 60, "minutes_to_session_close": closes * 60 - minute,
        "session_range_vs_avg": ratio(F.max("high").over(day) - F.min("low").over(day), "_avg20"), "day_of_week": F.weekday(ts), "is_monday": flag(F.weekday(ts) == 0),
    })


def previous_day(df: DataFrame, g: Config) -> DataFrame:
    daily = resampled(df.select(KEY, TIME, "open", "high", "low", "close", "volume"), "day")
    daily = daily.select(KEY, TIME, c("open").alias("_open"), *[F.lag(x).over(W()).alias(f"_p{x}") for x in ("open", "high", "low", "close", "volume")])
    daily = daily.withColumn("prev_session_volume_rank", percent_rank("_pvolume", 20))
    df = of_period(df, daily, "day")
    return df.withColumns({
        "prev_day_range_pct": percent(c("_phigh") - c("_plow"), "_pclose"), "prev_day_close_vs_pivot": percent(c("_pclose") - c("pivot_P"), "pivot_P"), "gap_pct": percent(c("_open") - c("_pclose"), "_pclose"),
        "dist_to_prev_day_high_pct": percent(c("close") - c("_phigh"), "close"), "dist_to_prev_day_low_pct": percent(c("close") - c("_plow"), "close"),
        "prev_session_direction": sign(c("_pclose") - c("_popen")), "daily_open_dist_pct": percent(c("close") - c("_open"), "_open"),
    })
