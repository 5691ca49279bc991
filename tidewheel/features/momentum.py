"""RSI, WaveTrend, stochastic, squeeze momentum, MACD, ADX, EMA distances and further oscillators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.exprs import (
    clipped, crosses_above, crosses_below, deviation, diff, full, highest, holds, lag, lowest, mean_deviation, percent, percent_rank, R, ratio, regression_end, sign, sma, total,
)
from tidewheel.plans.config import Config

c = F.col


def rsi(df: DataFrame, g: Config) -> DataFrame:
    r = c("rsi_14")
    df = df.withColumns({"rsi_sma_14": sma(r, g.rsi_mean), "_mid": sma(r, g.rsi_band), "_dev": deviation(r, g.rsi_band), "_lo": lowest(r, 20), "_hi": highest(r, 20), "rsi_direction": diff(r)})
    gap = c("rsi_14") - c("rsi_sma_14")
    up, low = c("_mid") + g.rsi_band_width * c("_dev"), c("_mid") - g.rsi_band_width * c("_dev")
    crossed = (crosses_above("rsi_14", "rsi_sma_14") + crosses_below("rsi_14", "rsi_sma_14")) > 0
    return df.withColumns({
        "rsi_minus_sma": gap, "rsi_sma_direction": diff("rsi_sma_14"), "rsi_sma_roc": diff("rsi_sma_14", 3) / 3, "rsi_accel": diff("rsi_direction"),
        "rsi_cross_speed": F.when(crossed, F.abs(gap)).otherwise(0.0), "rsi_bb_upper": up, "rsi_bb_lower": low,
        "rsi_bb_position": ratio(r - low, up - low), "rsi_range_pct": ratio(r - c("_lo"), c("_hi") - c("_lo")),
    })


def wave_trend(df: DataFrame, g: Config) -> DataFrame:
    w = c("wt1_5min")
    df = df.withColumns({"wt2_5min": sma(w, g.wt_signal), "wt1_direction": diff(w), "_lo": lowest(w, 20), "_hi": highest(w, 20)})
    df = df.withColumn("wt_hist_5min", w - c("wt2_5min"))
    return df.withColumns({
        "wt_cross_5min": crosses_above("wt1_5min", "wt2_5min") - crosses_below("wt1_5min", "wt2_5min"), "wt1_accel": diff("wt1_direction"), "wt_hist_direction": diff("wt_hist_5min"),
        "wt_ob_depth": clipped(w - g.wt_high, 0), "wt_os_depth": clipped(g.wt_low - w, 0), "wt_range_pct": ratio(w - c("_lo"), c("_hi") - c("_lo")),
    })


def stochastic(df: DataFrame, g: Config) -> DataFrame:
    n, k, d = g.stoch
    df = df.withColumns({"_lo": lowest("low", n), "_hi": highest("high", n)})
    df = df.withColumn("_fast", percent(c("close") - c("_lo"), c("_hi") - c("_lo")))
    df = df.withColumn("stoch_k", sma("_fast", k)).withColumn("stoch_d", sma("stoch_k", d))
    df = df.withColumn("stoch_kd_spread", c("stoch_k") - c("stoch_d"))
    return df.withColumns({"stoch_k_direction": diff("stoch_k"), "stoch_kd_spread_change": diff("stoch_kd_spread"), "stoch_range_pct": clipped((c("stoch_k") - 20) / 60, 0, 1)})


def squeeze_momentum(df: DataFrame, g: Config) -> DataFrame:
    n = g.squeeze_kc[0]
    df = df.withColumn("_off", c("close") - ((highest("high", n) + lowest("low", n)) / 2 + sma("close", n)) / 2)
    df = df.withColumn("squeeze_momentum", regression_end("_off", n))
    m = c("squeeze_momentum")
    df = df.withColumns({"squeeze_mom_accel": diff(m), "squeeze_mom_abs": F.abs(m)})
    return df.withColumns({
        "squeeze_mom_direction": sign(m), "squeeze_mom_accel2": diff("squeeze_mom_accel"), "squeeze_mom_zero_cross": crosses_above(m, 0) + crosses_below(m, 0),
        "squeeze_mom_percentile": percent_rank("squeeze_mom_abs", 50), "squeeze_mom_slope_5bar": diff(m, 5) / 5,
    })


def macd(df: DataFrame, g: Config) -> DataFrame:
    df = df.withColumn("macd_hist_5min", c("macd_line_5min") - c("macd_signal_5min"))
    df = df.withColumns({"macd_hist_direction": diff("macd_hist_5min"), "macd_line_direction": diff("macd_line_5min")})
    return df.withColumn("macd_hist_accel", diff("macd_hist_direction"))


def directional(df: DataFrame, g: Config) -> DataFrame:
    df = df.withColumns({"di_spread": c("di_plus") - c("di_minus"), "adx_direction": diff("adx"), "_lo": lowest("adx", 20), "_hi": highest("adx", 20)})
    df = df.withColumn("_abs", F.abs("di_spread"))
    return df.withColumns({
        "di_plus_roc": diff("di_plus", g.di_window), "di_minus_roc": diff("di_minus", g.di_window), "di_spread_roc": diff("di_spread", g.spread_window),
        "adx_accel": diff("adx_direction"), "adx_range_pct": ratio(c("adx") - c("_lo"), c("_hi") - c("_lo")), "di_convergence": diff("_abs", g.di_window),
    })


def averages(df: DataFrame, g: Config) -> DataFrame:
    """Distances from exponential and adaptive means and from the SAR."""
    from_close = lambda x: percent(c("close") - c(x), c("close"))
    out = {f"ema{n}_dist_pct": from_close(f"_ema{n}") for n in g.ema_periods}
    return df.withColumns(out | {f"{k}_dist_pct": from_close(f"_{k}") for k in ("kama", "dema", "tema")} | {"psar_dist_pct": from_close("_sar")})


def further(df: DataFrame, g: Config) -> DataFrame:
    """Williams %R, CCI, CMO, rate of change (TSI comes with the recursive series)."""
    df = df.withColumns({"_typical": (c("high") + c("low") + c("close")) / 3, "_step": diff("close")})
    df = df.withColumns({"_up": F.when(c("_step").isNotNull(), F.greatest(c("_step"), F.lit(0.0))), "_down": F.when(c("_step").isNotNull(), F.greatest(-c("_step"), F.lit(0.0)))})
    n = g.williams
    up, down = total("_up", g.cmo), total("_down", g.cmo)
    df = df.withColumns({
        "williams_r": -100 * ratio(highest("high", n) - c("close"), highest("high", n) - lowest("low", n)),
        "cci_20": ratio(c("_typical") - sma("_typical", g.cci), 0.015 * mean_deviation("_typical", g.cci)),
        "cmo_14": percent(up - down, up + down), "roc_10": (ratio("close", lag("close", g.roc)) - 1) * 100,
    })
    return df.withColumns({"williams_r_direction": diff("williams_r"), "cci_direction": diff("cci_20"), "cci_extreme": clipped(F.abs("cci_20") - 100, 0), "cmo_direction": diff("cmo_14")})


def ichimoku(df: DataFrame, g: Config) -> DataFrame:
    middle = lambda n: (highest("high", n) + lowest("low", n)) / 2
    t, k, b = g.ichimoku
    df = df.withColumns({"_tenkan": middle(t), "_kijun": middle(k), "_b": middle(b)})
    df = df.withColumn("_cloud", ((c("_tenkan") + c("_kijun")) / 2 + c("_b")) / 2)
    part = lambda x: percent(x, c("close"))
    return df.withColumns({
        "tenkan_dist_pct": part(c("close") - c("_tenkan")), "kijun_dist_pct": part(c("close") - c("_kijun")), "tk_cross": sign(c("_tenkan") - c("_kijun")),
        "tk_spread": part(c("_tenkan") - c("_kijun")), "cloud_dist_pct": part(c("close") - lag("_cloud", k)),
    })
