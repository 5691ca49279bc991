"""Event memory: how long ago, how often, how deep and how fast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.exprs import INDEX, KEY, TIME, U, bars_since, clipped, crosses_above, crosses_below, filled, flag, highest, holds, lag, lowest, sma, streak, total
from tidewheel.plans.config import Config

c = F.col


def episodes(df: DataFrame, state: str, name: str) -> DataFrame:
    """``name``_id numbers the runs of a 0/1 column, ``name``_run counts bars within one, ``name``_out marks the bar after one."""
    start = flag((c(state) == 1) & (F.coalesce(lag(state), F.lit(0)) == 0))
    df = df.withColumns({f"{name}_on": start, f"{name}_run": streak(c(state) == 1), f"{name}_out": flag((c(state) == 0) & (lag(state) == 1))})
    return df.withColumn(f"{name}_id", F.sum(f"{name}_on").over(U()))


def last_length(df: DataFrame, state: str, name: str, running: bool) -> DataFrame:
    """Bars of the last episode; of the running one, if asked, else of the last that has ended."""
    ended = F.when(c(f"{state}_out") == 1, lag(f"{state}_run"))
    if not running:
        return df.withColumn("_e", ended).withColumn(name, filled("_e")).drop("_e")
    df = df.withColumn("_e", ended)
    return df.withColumn(name, F.when(c(f"{state}_run") > 0, c(f"{state}_run")).otherwise(filled("_e"))).drop("_e")


def extreme(df: DataFrame, value: str, state: str, top: bool) -> Column:
    """The extreme of the running or else the last episode of ``state`` (after ``episodes``)."""
    within = Window.partitionBy(KEY, f"{state}_id").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    x = F.when(c(f"{state}_run") > 0, c(value))
    return (F.max(x) if top else F.min(x)).over(within)


def stochastic(df: DataFrame, g: Config) -> DataFrame:
    high, low = g.stoch_levels
    green = flag((crosses_above("stoch_k", "stoch_d") == 1) & (c("stoch_k") < low))
    red = flag((crosses_below("stoch_k", "stoch_d") == 1) & (c("stoch_k") > high))
    kind = F.when(c("stoch_k") > high, 1).when(c("stoch_k") < low, 2).otherwise(0)
    df = df.withColumns({"_green": green, "_red": red, "_ob": flag(c("stoch_k") > high), "_os": flag(c("stoch_k") < low), "_kind": F.coalesce(kind, F.lit(0))})
    df = df.withColumn("_far", flag(c("_kind") > 0))
    df = episodes(episodes(df, "_ob", "_ob"), "_os", "_os")
    df = last_length(last_length(df, "_ob", "stoch_bars_in_ob", True), "_os", "stoch_bars_in_os", True)
    # Depth of the latest episode of either kind: a change of kind starts a new one.
    df = df.withColumn("_turn", F.coalesce((c("_kind") != lag("_kind")).cast("int"), F.lit(1)))
    df = df.withColumn("_part", F.sum("_turn").over(U()))
    within = Window.partitionBy(KEY, "_part").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    depth = F.when(c("_kind") == 1, F.max("stoch_k").over(within) - high).when(c("_kind") == 2, low - F.min("stoch_k").over(within))
    df = df.withColumn("_depth", depth)
    df = recovery(df, "stoch_k", "_far", "stoch_recovery_speed")
    return df.withColumns({
        "stoch_bars_since_green": bars_since(c("_green") == 1), "stoch_bars_since_red": bars_since(c("_red") == 1), "stoch_green_count_50": total("_green", 50), "stoch_red_count_50": total("_red", 50),
        "stoch_last_extreme_depth": filled("_depth"),
    })


def recovery(df: DataFrame, value: str, state: str, name: str, target: float = 50.0) -> DataFrame:
    """Bars from the end of an extreme episode until the value reaches the target, carried on.

    Each exit starts a group of bars; its first bar at or beyond the target
    completes it, and a later exit starts anew.
    """
    df = df.withColumns({"_exit": flag((c(state) == 0) & (lag(state) == 1)), "_from": lag(value)})
    df = df.withColumn("_g", F.sum("_exit").over(U()))
    group = Window.partitionBy(KEY, "_g").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_up": F.first("_from").over(group) <= target, "_i0": F.first(INDEX).over(group)})
    there = F.when(c("_g") > 0, F.when(c("_up"), c(value) >= target).otherwise(c(value) <= target))
    df = df.withColumn("_there", flag(there))
    df = df.withColumn("_nth", F.sum("_there").over(group))
    df = df.withColumn("_speed", F.when((c("_there") == 1) & (c("_nth") == 1), c(INDEX) - c("_i0")))
    return df.withColumn(name, filled("_speed"))


def wave_trend(df: DataFrame, g: Config) -> DataFrame:
    df = df.withColumns({"_wob": flag(c("wt1_5min") > g.wt_high), "_wos": flag(c("wt1_5min") < g.wt_low), "_bull": crosses_above("wt1_5min", "wt2_5min"), "_bear": crosses_below("wt1_5min", "wt2_5min")})
    df = episodes(episodes(df, "_wob", "_wob"), "_wos", "_wos")
    df = df.withColumns({"_top": extreme(df, "wt1_5min", "_wob", True), "_bottom": extreme(df, "wt1_5min", "_wos", False)})
    entry = lambda s: F.when(lag(s).isNotNull(), F.greatest(c(s) - lag(s), F.lit(0)))
    df = df.withColumns({"_in": entry("_wob"), "_in2": entry("_wos")})
    return df.withColumns({
        "wt_bars_since_ob_exit": bars_since(c("_wob_out") == 1), "wt_bars_since_os_exit": bars_since(c("_wos_out") == 1), "wt_bars_since_bull_cross": bars_since(c("_bull") == 1), "wt_bars_since_bear_cross": bars_since(c("_bear") == 1),
        "wt_ob_count_100": total("_in", 100), "wt_os_count_100": total("_in2", 100), "wt_last_ob_depth": clipped(filled("_top") - g.wt_high, 0), "wt_last_os_depth": clipped(g.wt_low - filled("_bottom"), 0),
    })


def rsi(df: DataFrame, g: Config) -> DataFrame:
    high, low, middle = g.rsi_levels
    df = df.withColumns({"_rob": flag(c("rsi_14") > high), "_ros": flag(c("rsi_14") < low), "_cross": crosses_above("rsi_14", middle) + crosses_below("rsi_14", middle), "_above": flag(c("rsi_14") > middle)})
    entry = lambda s: F.when(lag(s).isNotNull(), F.greatest(c(s) - lag(s), F.lit(0)))
    df = df.withColumns({"_in": entry("_rob"), "_in2": entry("_ros")})
    return df.withColumns({
        "rsi_bars_since_ob": bars_since(c("_rob") == 1), "rsi_bars_since_os": bars_since(c("_ros") == 1), "rsi_bars_since_50_cross": bars_since(c("_cross") > 0),
        "rsi_ob_count_100": total("_in", 100), "rsi_os_count_100": total("_in2", 100), "rsi_time_above_50_pct": sma("_above", 50) * 100,
    })


def macd(df: DataFrame, g: Config) -> DataFrame:
    h, line = "macd_hist_5min", "macd_line_5min"
    df = df.withColumns({"_bull": crosses_above(h, 0), "_bear": crosses_below(h, 0), "_zero": crosses_above(line, 0) + crosses_below(line, 0)})
    return df.withColumns({
        "macd_bars_since_bull_cross": bars_since(c("_bull") == 1), "macd_bars_since_bear_cross": bars_since(c("_bear") == 1), "macd_bars_since_zero_cross": bars_since(c("_zero") > 0),
        "macd_hist_max_50": highest(h, 50), "macd_hist_min_50": lowest(h, 50),
    })


def squeeze(df: DataFrame, g: Config) -> DataFrame:
    df = df.withColumns({"_fire": flag(c("squeeze_state") == 1), "_sq": flag(c("squeeze_state") == -1)})
    df = last_length(episodes(df, "_sq", "_sq"), "_sq", "squeeze_duration_last", False)
    df = df.withColumns({"_fires": F.sum("_fire").over(U()), "_mf": F.when(c("_fire") == 1, c("squeeze_momentum"))})
    since = Window.partitionBy(KEY, "_fires").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({
        "squeeze_bars_since_fire": bars_since(c("_fire") == 1), "squeeze_count_200": total("_fire", 200), "squeeze_momentum_at_fire": filled("_mf"), "squeeze_mom_peak_since_fire": F.max(F.abs("squeeze_momentum")).over(since),
    })


def directional(df: DataFrame, g: Config) -> DataFrame:
    trend, weak = g.adx_levels
    df = df.withColumn("_cross", crosses_above("di_plus", "di_minus") + crosses_below("di_plus", "di_minus"))
    return df.withColumns({"adx_bars_since_trend": bars_since(c("adx") > trend), "adx_bars_since_weak": bars_since(c("adx") < weak), "di_bars_since_cross": bars_since(c("_cross") > 0), "adx_peak_50": highest("adx", 50)})


def price(df: DataFrame, g: Config) -> DataFrame:
    near = flag(c("dist_to_nearest_pivot_pct") <= g.touch_percent)
    df = df.withColumns({"_nh": holds(c("high") == highest("high", 20)), "_nl": holds(c("low") == lowest("low", 20)), "_near": near, "_spike": holds(c("volume") > g.volume_spike * sma("volume", 20))})
    day = Window.partitionBy(KEY, F.to_date(TIME)).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({
        "bars_since_new_high_20": bars_since(c("_nh")), "bars_since_new_low_20": bars_since(c("_nl")), "bars_since_pivot_touch": bars_since(c("_near") == 1),
        "pivot_touch_count_today": F.sum("_near").over(day), "bars_since_volume_spike": bars_since(c("_spike")),
    })
