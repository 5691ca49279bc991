"""Volume flow, buying and selling pressure, money flow, VWAP."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.exprs import KEY, TIME, clipped, crosses_above, crosses_below, diff, highest, lag, lowest, percent, ratio, running_total, sign, sma, total
from tidewheel.plans.config import Config

c = F.col


def flow(df: DataFrame, g: Config) -> DataFrame:
    df = df.withColumns({"vfi_hist": c("vfi") - c("vfi_signal"), "_lo": lowest("vfi", 50), "_hi": highest("vfi", 50)})
    return df.withColumns({"vfi_direction": diff("vfi"), "vfi_hist_direction": diff("vfi_hist"), "vfi_cross_zero": crosses_above("vfi", 0) - crosses_below("vfi", 0), "vfi_range_pct": ratio(c("vfi") - c("_lo"), c("_hi") - c("_lo"))})


def pressure(df: DataFrame, g: Config) -> DataFrame:
    buy = clipped(ratio(c("close") - c("low"), c("high") - c("low")), 0, 1)
    df = df.withColumns({"buy_volume_pct": buy, "sell_volume_pct": 1 - buy, "_step": diff("close")})
    bought, sold = c("volume") * c("buy_volume_pct"), c("volume") * c("sell_volume_pct")
    df = df.withColumns({"_delta": bought - sold, "_bs": ratio(bought, sold), "_obv": running_total(F.coalesce(sign("_step"), F.lit(0.0)) * c("volume")), "_v20": sma("volume", 20), "_v5": sma("volume", 5)})
    return df.withColumns({
        "volume_ratio": ratio("volume", "_v20"), "volume_trend": ratio("_v5", "_v20"), "buy_sell_ratio_sma5": sma("_bs", 5),
        "cum_delta_5": total("_delta", 5), "cum_delta_20": total("_delta", 20), "obv_slope": diff("_obv", 10) / 10,
    })


def money_flow(df: DataFrame, g: Config) -> DataFrame:
    typical = (c("high") + c("low") + c("close")) / 3
    df = df.withColumns({"_typical": typical, "_mf": ratio(2 * c("close") - c("low") - c("high"), c("high") - c("low")) * c("volume")})
    up, down = c("_typical") > lag("_typical"), c("_typical") < lag("_typical")
    raw = c("_typical") * c("volume")
    df = df.withColumns({"_in": F.when(up, raw).otherwise(0.0), "_out": F.when(down, raw).otherwise(0.0), "_ad": running_total("_mf"), "cmf_20": ratio(total("_mf", 20), total("volume", 20))})
    # The line has no value on bars without a range, though the sum goes on.
    df = df.withColumns({"ad_line": F.when(c("_mf").isNotNull(), c("_ad")), "mfi_14": 100 - 100 / (1 + ratio(total("_in", 14), total("_out", 14)))})
    return df.withColumns({
        "cmf_direction": diff("cmf_20"), "mfi_direction": diff("mfi_14"), "ad_slope_10": diff("ad_line", 10) / 10,
        "mfi_rsi_divergence": c("mfi_14") - c("rsi_14"), "cmf_vfi_agreement": sign("cmf_20") * sign("vfi"),
    })


def vwap(df: DataFrame, g: Config) -> DataFrame:
    """Volume-weighted price of the day so far, with bands of the day's last closes."""
    day = Window.partitionBy(KEY, F.to_date(TIME)).orderBy(TIME)
    so_far, band = day.rowsBetween(Window.unboundedPreceding, 0), day.rowsBetween(-(g.vwap_band - 1), 0)
    typical = (c("high") + c("low") + c("close")) / 3
    df = df.withColumns({
        "vwap_daily": ratio(F.sum(typical * c("volume")).over(so_far), F.sum("volume").over(so_far)),
        "_dev": F.when(F.count("close").over(band) == g.vwap_band, F.stddev_pop("close").over(band)),
    })
    v = c("vwap_daily")
    df = df.withColumns({"vwap_session": v, "vwap_dist_pct": percent(c("close") - v, "close"), "vwap_session_dist_pct": percent(c("close") - v, "close"), "vwap_upper_band": v + c("_dev"), "vwap_lower_band": v - c("_dev")})
    return df.withColumns({"vwap_slope": percent(diff("vwap_daily", 5), lag("vwap_daily", 5)), "vwap_band_position": ratio(c("close") - c("vwap_lower_band"), c("vwap_upper_band") - c("vwap_lower_band"))})
