"""Mean reversion, moments, autocorrelation, entropy and fractal measures, market regime."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tidewheel.functions.exprs import INDEX, R, U, clipped, correlation, deviation, diff, flag, full, highest, kurtosis, lag, lowest, ratio, skewness, sma, total
from tidewheel.plans.config import Config

c = F.col


def mean_reversion(df: DataFrame, g: Config) -> DataFrame:
    n, k = g.bb
    z = lambda x, m: ratio(c(x) - sma(x, m), deviation(x, m))
    back = lambda m: (ratio("close", lag("close", m)) - 1) * 100
    low, wide = sma("close", n) - k * deviation("close", n), 2 * k * deviation("close", n)
    df = df.withColumns({"zscore_20": z("close", 20), "zscore_50": z("close", 50), "bb_position": ratio(c("close") - low, wide), "rsi_zscore": z("rsi_14", 50), "return_5bar": back(5), "return_20bar": back(20), "return_60bar": back(60)})
    return df.withColumn("mean_reversion_score", clipped((c("zscore_20") + c("zscore_50")) / 2, -3, 3))


def hurst(windows: np.ndarray) -> np.ndarray:
    """Log of the rescaled range over log of the length, for each row."""
    n = windows.shape[1]
    walk = np.cumsum(windows - windows.mean(1, keepdims=True), axis=1)
    reach, spread = walk.max(1) - walk.min(1), windows.std(1)
    flat = (reach == 0) | (spread == 0)
    return np.where(flat, np.nan, np.log(np.where(flat, 1.0, reach) / np.where(flat, 1.0, spread)) / math.log(n))


def box_dimension(windows: np.ndarray) -> np.ndarray:
    """Slope of the number of dyadic boxes that each row's path touches, jumps between columns filled in.

    At each scale the boxes are a grid of columns and rows: single points are marked, and what a jump passes is the
    running sum of a mark where it begins and one where it ends (one jump leads into each column).
    """
    m, n = windows.shape
    scales = int(math.log2(n))
    if scales < 3:
        return np.full(m, np.nan)
    reach = windows.max(1) - windows.min(1)
    flat = reach == 0
    column, level = np.arange(n) / (n - 1), (windows - windows.min(1, keepdims=True)) / np.where(flat, 1.0, reach)[:, None]
    counts = np.empty((m, scales))
    row = np.arange(m)[:, None]
    for k in range(1, scales + 1):
        i, j = np.floor(column * 2**k).astype(int), np.floor(level * 2**k).astype(int)
        jump = np.flatnonzero(np.diff(i)) + 1
        marks = np.zeros((m, 2**k + 1, 2**k + 2), np.int8)
        marks[row, i[jump], np.minimum(j[:, jump - 1], j[:, jump])] += 1
        marks[row, i[jump], np.maximum(j[:, jump - 1], j[:, jump]) + 1] -= 1
        touched = np.cumsum(marks, axis=2, dtype=np.int8) > 0
        touched[row, i, j] = True
        counts[:, k - 1] = touched.sum((1, 2))
    x = np.arange(1, scales + 1) * math.log(2)
    x = x - x.mean()
    return np.where(flat, np.nan, (np.log(counts) @ x) / (x @ x))


def _by_windows(x: pd.Series, measure) -> pd.Series:
    """``measure`` of a batch's windows, in blocks of some MB; null where there is no window."""
    out = np.full(len(x), np.nan)
    there = np.flatnonzero(x.notna().to_numpy())
    for k in range(0, len(there), 1024):
        at = there[k : k + 1024]
        out[at] = measure(np.stack(x.iloc[at].to_numpy()))
    return pd.Series(out).astype("Float64").mask(np.isnan(out))


@pandas_udf(DoubleType())
def hurst_of(x: pd.Series) -> pd.Series:
    return _by_windows(x, hurst)


@pandas_udf(DoubleType())
def box_dimension_of(x: pd.Series) -> pd.Series:
    return _by_windows(x, box_dimension)


def with_entropy(df: DataFrame, x: str, n: int, name: str, bins: int = 10) -> DataFrame:
    """Adds the Shannon entropy of the last n values in equal bins between their extremes; 0 where they are all the same."""
    df = df.withColumns({"_ev": F.collect_list(c(x)).over(R(n)), "_el": F.min(x).over(R(n)), "_eh": F.max(x).over(R(n))})
    df = df.withColumn("_ew", (c("_eh") - c("_el")) / F.lit(float(bins)))
    at = F.transform("_ev", lambda v: F.least(F.floor(F.try_divide(v - c("_el"), c("_ew"))), F.lit(bins - 1)))
    df = df.withColumn("_ek", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(at, lambda v: v == b)) / F.lit(float(n))))
    bits = F.aggregate("_ek", F.lit(0.0), lambda total, p: total + F.when(p > 0, -p * F.ln(p)).otherwise(0.0))
    return df.withColumn(name, F.when(F.size("_ev") == n, F.when(c("_eh") == c("_el"), 0.0).otherwise(bits))).drop("_ev", "_el", "_eh", "_ew", "_ek")


def statistical(df: DataFrame, g: Config) -> DataFrame:
    df = df.withColumns({"_l1": lag("_return", 1), "_l5": lag("_return", 5), "_r10": total("_return", 10), "_hl": F.pow(F.ln(ratio("high", "low")), F.lit(2.0))})
    df = with_entropy(df, "_return", 50, "price_entropy")
    history = lambda x, n: full(x, n, F.collect_list(c(x)).over(R(n)))
    df = df.withColumns({
        "_rs": history("_return", g.hurst), "_cs": history("close", g.fractal_dim),
        "autocorrelation_1": full("_return", 50, correlation("_return", "_l1", R(49), 49)), "autocorrelation_5": full("_return", 50, correlation("_return", "_l5", R(45), 45)),
        "skewness_20": skewness("_return", 20), "kurtosis_20": kurtosis("_return", 20),
        "variance_ratio": full("_return", 20, ratio(F.var_pop("_r10").over(R(11)), 10 * F.var_pop("_return").over(R(20)))),
        "parkinson_vol": full("_hl", g.parkinson, F.sqrt(F.avg("_hl").over(R(g.parkinson)) / (4 * math.log(2)))),
    })
    return df.withColumns({"hurst_exponent": hurst_of("_rs"), "fractal_dimension": box_dimension_of("_cs")}).drop("_rs", "_cs")


def regime(df: DataFrame, g: Config) -> DataFrame:
    df = df.withColumns({
        "regime_trending": flag((c("adx") > 25) & (F.abs(c("di_plus") - c("di_minus")) > 10)), "regime_ranging": flag((c("adx") < 20) & (c("bb_width_percentile") < 30)),
        "regime_volatile": flag(c("atr_percentile") > 80), "regime_quiet": flag(c("atr_percentile") < 20), "_moved": F.abs(diff("close")), "_spread": highest("high", 14) - lowest("low", 14), "_atrs": total("atr_14", 14),
    })
    on = lambda x: c(f"regime_{x}") == 1
    df = df.withColumn("_regime", F.when(on("trending"), 1).when(on("volatile"), 2).when(on("quiet"), 3).when(on("ranging"), 4).otherwise(0))
    df = df.withColumn("_new", F.coalesce(c("_regime") != lag("_regime"), F.lit(True)))
    quotient = ratio("_atrs", "_spread")
    return df.withColumns({
        "bars_in_current_regime": c(INDEX) - F.last(F.when(c("_new"), c(INDEX)), ignorenulls=True).over(U()) + 1, "efficiency_ratio": ratio(F.abs(diff("close", 14)), total("_moved", 14)),
        "choppiness_index": F.when(quotient > 0, 100 * F.log10(quotient) / math.log10(14)),
    })
