"""Setups at levels, lagged dynamics, and features of the higher timeframes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.features.levels import LEVELS
from tidewheel.functions.exprs import bars_since, clipped, crosses_above, crosses_below, diff, filled, highest, holds, lag, lowest, percent, ratio, sign, sma
from tidewheel.operators.bars import previous_higher
from tidewheel.plans.config import Config

c = F.col
#: Share of an ATR within which a close is at a level, and bars after a touch at which the bounce is read.
NEAR, AFTER = 0.3, 5


def at_level(level: str, atr: str = "atr_14"):
    return holds(F.abs(c("close") - c(level)) <= NEAR * c(atr))


def higher_columns(bars: DataFrame, g: Config) -> tuple[DataFrame, list[str]]:
    """Features of the next timeframe on its own bars (recursive series and ``bar`` present), and their names."""
    out = bars.withColumns({"wt2_1h": sma("wt1_1h", g.wt_signal), "macd_hist_1h_direction": diff("macd_hist_1h"), "vfi_1h_direction": diff("vfi_1h")})
    out = out.withColumn("wt_cross_1h", crosses_above("wt1_1h", "wt2_1h") - crosses_below("wt1_1h", "wt2_1h"))
    names = ["wt1_1h", "wt2_1h", "wt_cross_1h", "macd_hist_1h", "macd_hist_1h_direction", "adx_1h", "vfi_1h", "vfi_1h_direction"]
    out = out.withColumns({f"ema{n}_1h_dist_pct": percent(c("close") - c(f"_ema{n}_1h"), "close") for n in g.ema_periods_1h})
    a, b, d = (c(f"_ema{n}_1h") for n in g.ema_periods_1h[:3])
    out = out.withColumn("ema_stack_1h", sign(a - b) + sign(b - d) + sign(c("close") - a))
    names += [f"ema{n}_1h_dist_pct" for n in g.ema_periods_1h] + ["ema_stack_1h"]
    for n in (50, 200):
        out = out.withColumn("_at", at_level(f"_free_ema{n}_1h", "_atr_free")).withColumn(f"bars_since_ema{n}_touch_1h", bars_since(c("_at")))
        names.append(f"bars_since_ema{n}_touch_1h")
    out = out.withColumn("_slope_1h", diff("_free_ema50_1h", 4))
    return out, [*names, "_slope_1h"]


def daily_columns(bars: DataFrame, g: Config) -> tuple[DataFrame, list[str]]:
    out = bars.withColumns({f"ema{n}_1d_dist_pct": percent(c("close") - c(f"_ema{n}_1d"), "close") for n in g.ema_periods_1d})
    a, b, d = (c(f"_ema{n}_1d") for n in g.ema_periods_1d)
    out = out.withColumn("ema_stack_1d", sign(a - b) + sign(b - d) + sign(c("close") - a))
    return out, [f"ema{n}_1d_dist_pct" for n in g.ema_periods_1d] + ["ema_stack_1d"]


def higher(df: DataFrame, next_bars: DataFrame, daily: DataFrame, g: Config, unit: str = "hour") -> DataFrame:
    """Features of the last finished bar of both higher timeframes."""
    hours, names = higher_columns(next_bars, g)
    df = previous_higher(df, hours, names, unit)
    days, names = daily_columns(daily, g)
    return previous_higher(df, days, names, "day")


def _away(column: str):
    return lambda x: F.abs(c(column) - x)


def at_levels(df: DataFrame, g: Config) -> DataFrame:
    """EMA touches and bounces, confluence with pivots, patterns at levels, pullback depth."""
    levels = F.array(*[f"pivot_{k}" for k in LEVELS])
    for n in (21, 50):
        ema = f"_free_ema{n}"
        df = df.withColumns({f"_touch{n}": at_level(ema), f"_place{n}": ratio(c("close") - c(ema), "atr_14"), f"ema{n}_pivot_confluence": ratio(F.array_min(F.transform(levels, _away(ema))), "atr_14")})
        df = df.withColumn("_read", F.when(holds(lag(f"_touch{n}", AFTER)), c(f"_place{n}")))
        df = df.withColumns({f"bars_since_ema{n}_touch_5m": bars_since(c(f"_touch{n}")), f"ema{n}_bounce_5bar_5m": filled("_read")})
    df = df.withColumns({"_slope": diff("_free_ema50", 12), "_ema_near": c("_touch21") | c("_touch50"), "_pivot_near": holds(F.exists(levels, lambda x: F.abs(c("close") - x) <= NEAR * c("atr_14")))})
    hi, lo = highest("close", 20), lowest("close", 20)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    at = lambda x, where: F.when(c(where), c(x)).otherwise(0).cast("double")
    return df.withColumns({
        "mtf_trend_alignment": zero(sign("_slope")) * zero(sign("_slope_1h")), "pin_bar_at_ema": at("pin_bar", "_ema_near"), "pin_bar_at_pivot": at("pin_bar", "_pivot_near"),
        "engulf_at_ema": at("engulfing", "_ema_near"), "engulf_at_pivot": at("engulfing", "_pivot_near"), "pullback_depth_pct": clipped(ratio(hi - c("close"), hi - lo), 0, 1),
        "dist_from_range_high_20_pct": percent(hi - c("close"), "close"), "dist_from_range_low_20_pct": percent(c("close") - lo, "close"),
    })


def lagged(df: DataFrame, g: Config) -> DataFrame:
    df = df.withColumn("_v3", sma("volume", 3))
    slope = lambda x: diff(x, 5) / 5
    rate = lambda x: percent(diff(x, 5), lag(x, 5))
    return df.withColumns({
        "rsi_5bar_ago": lag("rsi_14", 5), "wt1_slope_5bar": slope("wt1_5min"), "adx_slope_5bar": slope("adx"), "atr_slope_5bar": rate("atr_14"), "volume_slope_5bar": rate("_v3"),
        "vwap_slope_5bar": rate("vwap_daily"), "di_spread_change_5bar": diff("di_spread", 5), "squeeze_mom_slope": diff("squeeze_momentum", 3) / 3,
    })
