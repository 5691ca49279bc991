"""Shapes of candles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.exprs import R, flag, lag, ratio, streak
from tidewheel.plans.config import Config

c = F.col


def candles(df: DataFrame, g: Config) -> DataFrame:
    o, h, l, x = c("open"), c("high"), c("low"), c("close")
    df = df.withColumns({"_body": F.abs(x - o), "body_pct": ratio(F.abs(x - o), h - l), "upper_wick_pct": ratio(h - F.greatest(o, x), h - l), "lower_wick_pct": ratio(F.least(o, x) - l, h - l)})
    po, px = lag("open"), lag("close")
    bull, bear = flag((x > o) & (px < po) & (x >= po) & (o <= px)), flag((x < o) & (px > po) & (x <= po) & (o >= px))
    pin = lambda wick, other: flag((c(wick) > 2 * c("body_pct")) & (c(other) < c("body_pct")))
    return df.withColumns({
        "is_bullish": flag(x > o), "consecutive_bull": streak(x > o), "consecutive_bear": streak(x < o), "body_vs_prev_body": ratio("_body", lag("_body")),
        "engulfing": bull - bear, "pin_bar": pin("lower_wick_pct", "upper_wick_pct") - pin("upper_wick_pct", "lower_wick_pct"),
    })


def heikin_ashi(df: DataFrame, g: Config | None = None) -> DataFrame:
    """Averaged candles. The open is a running mean that halves the past, so sixty bars hold a float's precision."""
    df = df.withColumn("ha_close", (c("open") + c("high") + c("low") + c("close")) / 4)
    past = F.collect_list(F.struct("open", "close", "ha_close")).over(R(60))
    start = (past[0]["open"] + past[0]["close"]) / 2
    opened = F.aggregate(F.slice(past, 1, F.size(past) - 1), start, lambda a, b: (a + b["ha_close"]) / 2)
    df = df.withColumn("ha_open", opened)
    return df.withColumns({"ha_high": F.greatest("high", "ha_open", "ha_close"), "ha_low": F.least("low", "ha_open", "ha_close")})
