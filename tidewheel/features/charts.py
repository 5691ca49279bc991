"""Chart indicators with a direction: 1 for long, -1 for short, 0 for neither.

Periods are the usual ones and can be changed.  Those that are windows stay window expressions; exponential means and
the ratcheting stop come from ``chart_series``, one grouped pass per symbol.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.exprs import deviation, diff, filled, full, highest, lag, lowest, R, ratio, sma, total, true_range
from tidewheel.operators.recursive import ema, range_of, wilder

c = F.col


def direction(up: Column, down: Column) -> Column:
    return F.when(up, 1).when(down, -1).otherwise(0)


def weighted(x: str, n: int) -> Column:
    """Mean of the last n with weights 1 to n, the latest the heaviest."""
    values = F.collect_list(c(x)).over(R(n))
    whole = F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return full(x, n, whole / F.lit(n * (n + 1) / 2.0))


def chandelier(b: pd.DataFrame, n: int = 22, mult: float = 3.0) -> dict[str, pd.Series]:
    """Stops that hang below the highest and above the lowest close; each only tightens while the close stays on its side."""
    close, gap = b["close"], mult * wilder(range_of(b), n)
    hang = {1: (close.rolling(n).max() - gap).to_numpy(), -1: (close.rolling(n).min() + gap).to_numpy()}
    at, stops, way = close.to_numpy(), {1: np.full(len(b), np.nan), -1: np.full(len(b), np.nan)}, np.ones(len(b))
    for i in range(len(b)):
        before = {}
        for side, raw in hang.items():
            last = stops[side][i - 1] if i else np.nan
            before[side] = raw[i] if np.isnan(last) else last
            held = i and side * at[i - 1] > side * before[side]
            stops[side][i] = side * max(side * raw[i], side * before[side]) if held else raw[i]
        way[i] = 1 if at[i] > before[-1] else -1 if at[i] < before[1] else way[i - 1] if i else 1
    return {"chandelier_long": pd.Series(stops[1]), "chandelier_short": pd.Series(stops[-1]), "chandelier_direction": pd.Series(way)}


def chart_series(b: pd.DataFrame, cfg) -> dict[str, pd.Series]:
    """Recursive series that the indicators below read."""
    out = {f"_e{n}": ema(b["close"], n, warm=False) for n in (3, 8, 9, 20, 21, 40, 50)}
    return out | {f"_w{n}": wilder(range_of(b), n, warm=False) for n in (5, 100)} | chandelier(b)


def crosses(df: DataFrame) -> DataFrame:
    """Two and three exponential means in order."""
    a, b, d = c("_e9"), c("_e21"), c("_e50")
    return df.withColumns({"ema_pair": direction(a > b, a < b), "ema_triple": direction((a > b) & (b > d), (a < b) & (b < d)), "wolf_spread": (c("_e3") - c("_e8")) * 1.001})


def donchian(df: DataFrame, n: int = 15) -> DataFrame:
    """Direction of the last close beyond the channel of the n bars before it."""
    out = F.when(c("close") > lag(highest("high", n)), 1).when(c("close") < lag(lowest("low", n)), -1)
    return df.withColumn("_out", out).withColumn("donchian_trend", F.coalesce(filled("_out"), F.lit(0))).drop("_out")


def power(df: DataFrame, n: int = 50, least: float = 2.0) -> DataFrame:
    """Distances from the extremes in short ATRs."""
    bull, bear = ratio(c("close") - lowest("low", n), "_w5"), ratio(highest("high", n) - c("close"), "_w5")
    df = df.withColumns({"bull_power": bull, "bear_power": bear})
    return df.withColumn("power_direction", direction(c("bear_power") < least, c("bull_power") < least))


def detrended(df: DataFrame, n: int = 10) -> DataFrame:
    return df.withColumn("_m", sma("close", n)).withColumn("dpo", c("close") - lag("_m", n // 2 + 1)).drop("_m")


def band_cycle(df: DataFrame, n: int = 20, mult: float = 2.0, smooth: int = 6, trigger: int = 4) -> DataFrame:
    """Distance from the band's middle, smoothed, and its trigger line."""
    df = df.withColumn("_m", sma("close", n))
    df = df.withColumn("_p", (c("_m") - c("close")) / (c("_m") + c("close") / 2)).withColumn("_s", weighted("_p", smooth))
    df = df.withColumn("bb_cycle", -(c("_s") + sma("_s", 2)))
    return df.withColumn("bb_cycle_trigger", sma("bb_cycle", trigger)).drop("_m", "_p", "_s")


def channel_side(df: DataFrame, n: int = 10) -> DataFrame:
    """Which of the means of highs and lows the close has left last."""
    df = df.withColumn("_out", F.when(c("close") > sma("high", n), 1).when(c("close") < sma("low", n), -1))
    return df.withColumn("ssl_direction", filled("_out")).drop("_out")


def explosion(df: DataFrame, n: int = 20, mult: float = 2.0, sensitivity: float = 150.0) -> DataFrame:
    """The change of a MACD line against the width of the bands and a dead zone of ATRs."""
    df = df.withColumns({"_line": c("_e20") - c("_e40"), "wae_width": 2 * mult * deviation("close", n), "wae_dead": 3.7 * c("_w100")})
    df = df.withColumn("wae_trend", diff("_line") * sensitivity).drop("_line")
    strong = lambda x: (x > c("wae_width")) & (c("wae_width") > c("wae_dead")) & (x > c("wae_dead"))
    return df.withColumn("wae_direction", direction(strong(c("wae_trend")), strong(-c("wae_trend"))))


def vortex(df: DataFrame, n: int = 14) -> DataFrame:
    df = df.withColumns({"_up": F.abs(c("high") - lag("low")), "_down": F.abs(c("low") - lag("high")), "_tr": true_range()})
    return df.withColumns({"vortex_plus": ratio(total("_up", n), total("_tr", n)), "vortex_minus": ratio(total("_down", n), total("_tr", n))}).drop("_up", "_down", "_tr")


def awesome(df: DataFrame, fast: int = 5, slow: int = 34) -> DataFrame:
    df = df.withColumn("_mid", (c("high") + c("low")) / 2)
    df = df.withColumn("awesome", sma("_mid", fast) - sma("_mid", slow)).drop("_mid")
    return df.withColumns({"awesome_change": diff("awesome"), "awesome_accel": c("awesome") - sma("awesome", fast)})


def body_spike(df: DataFrame, n: int = 100) -> DataFrame:
    """Whether a bar's body leaves the deviation of the last n bodies."""
    df = df.withColumn("_b", c("close") - c("open"))
    return df.withColumn("spike_limit", deviation("_b", n)).withColumn("spike_direction", direction(c("_b") > c("spike_limit"), c("_b") < -c("spike_limit"))).drop("_b")


def hull(df: DataFrame, n: int = 55) -> DataFrame:
    """Hull's mean: the weighted mean of twice the half-length mean less the whole one."""
    df = df.withColumn("_h", 2 * weighted("close", n // 2) - weighted("close", n))
    df = df.withColumn("hull", weighted("_h", round(n**0.5))).drop("_h")
    return df.withColumn("hull_direction", direction(c("hull") > lag("hull", 2), c("hull") < lag("hull", 2)))


def kernel(df: DataFrame, n: int = 26, width: float = 8.0, shape: float = 8.0) -> DataFrame:
    """Mean of the last n closes with rational quadratic weights, and where it points."""
    weights = F.array(*[F.lit((1 + k * k / (2 * shape * width * width)) ** -shape) for k in range(n)])
    values = F.reverse(F.collect_list("close").over(R(n)))
    df = df.withColumn("_k", values)
    whole = F.aggregate(F.zip_with("_k", weights, lambda v, w: v * w), F.lit(0.0), lambda a, b: a + b)
    df = df.withColumn("kernel_mean", F.when(F.size("_k") == n, whole / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))).drop("_k")
    return df.withColumn("kernel_direction", direction(diff("kernel_mean") > 0, diff("kernel_mean") < 0))


def all_directions(df: DataFrame) -> DataFrame:
    """Every window indicator of this module on bars with ``chart_series``."""
    for family in (crosses, donchian, power, detrended, band_cycle, channel_side, explosion, vortex, awesome, body_spike, hull, kernel):
        df = family(df)
    return df
