"""ATR, band widths, squeeze state, realized volatility and candle range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.exprs import KEY, TIME, bars_since, deviation, diff, holds, lag, percent, percent_rank, ratio, sma, true_range
from tidewheel.plans.config import Config

c = F.col


def day_window(causal: bool):
    """The day so far, or, as older feature sets had it, the whole day."""
    w = Window.partitionBy(KEY, F.to_date(TIME))
    return w.orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0) if causal else w


def volatility(df: DataFrame, g: Config) -> DataFrame:
    n, k = g.bb
    sn, sk = g.squeeze_bb
    kn, kk = g.squeeze_kc
    df = df.withColumns({"_tr": true_range(), "_return": F.when(lag("close") > 0, F.ln(ratio("close", lag("close")))), "atr_pct": percent("atr_14", "close"), "atr_ratio": ratio("_atr_short", "atr_14")})
    df = df.withColumns({"_bb": deviation("close", n), "_sbb": deviation("close", sn), "_mean": sma("close", n), "_smean": sma("close", sn), "_kmean": sma("close", kn), "_ktr": sma("_tr", kn)})
    inside = (c("_smean") + sk * c("_sbb") < c("_kmean") + kk * c("_ktr")) & (c("_smean") - sk * c("_sbb") > c("_kmean") - kk * c("_ktr"))
    df = df.withColumns({"bb_width": percent(2 * k * c("_bb"), "_mean"), "kc_width": percent(2 * kk * c("_ktr"), "_kmean"), "_inside": holds(inside)})
    df = df.withColumn("squeeze_state", F.when(c("_inside"), -1.0).when(holds(lag("_inside")), 1.0).otherwise(0.0))
    df = df.withColumns({"realized_vol_5": deviation("_return", 5), "realized_vol_20": deviation("_return", 20)})
    first = Window.partitionBy(KEY, F.to_date(TIME)).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    day = day_window(g.causal)
    return df.withColumns({
        "atr_percentile": percent_rank("atr_14", g.atr_rank), "atr_roc": percent(diff("atr_14", g.atr_window), lag("atr_14", g.atr_window)), "bb_width_percentile": percent_rank("bb_width", 100),
        "bars_since_squeeze_release": bars_since(c("squeeze_state") == 1), "vol_ratio_5_20": ratio("realized_vol_5", "realized_vol_20"), "high_low_range_pct": percent(c("high") - c("low"), "close"),
        "session_range_pct": percent(F.max("high").over(day) - F.min("low").over(day), F.first("open").over(first)),
    })
