"""The feature matrix: base bars and two higher timeframes in, one wide table out.

Recursive series first (one grouped pass per timeframe), then families of window
expressions, all with the same partitioning and order.  Between groups of families the
table can be cut by ``cut`` (say, a written table) to keep plans small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.features import candles, context, events, levels, momentum, statistics, structure, volatility, volume
from tidewheel.functions.exprs import KEY, TIME, indexed
from tidewheel.operators.bars import resampled
from tidewheel.operators.recursive import base_series, daily_series, higher_series, with_series
from tidewheel.plans.config import DEFAULT, Config

BARS = ["open", "high", "low", "close", "volume"]

#: Families in the order in which they need each other.
LAYERS = [
    [momentum.rsi, momentum.wave_trend, momentum.stochastic, momentum.squeeze_momentum, momentum.macd, momentum.directional, momentum.averages],
    [momentum.further, momentum.ichimoku, volatility.volatility, candles.candles],
    [volume.flow, volume.pressure, volume.money_flow, volume.vwap],
    [levels.pivots, lambda df, g: levels.pivots(df, g, "week"), levels.sessions, levels.previous_day],
    [statistics.mean_reversion, statistics.statistical, statistics.regime, context.lagged],
    [structure.divergences, structure.swings],
    [events.stochastic, events.wave_trend, events.rsi, events.macd, events.squeeze, events.directional, events.price],
]


def no_scratch(df: DataFrame) -> DataFrame:
    """Drops helper columns, but for those that later families read."""
    keep = {"_atr_short", "_return", "_slope_1h", "_free_ema21", "_free_ema50"}
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in keep])


def matrix(bars: DataFrame, next_bars: DataFrame | None = None, unit: str = "hour", g: Config = DEFAULT, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(symbol, ts, open..volume and every feature) for base ``bars``.

    ``next_bars`` are bars of ``unit``; by default they are resampled from the base.
    """
    bars = bars.select(KEY, TIME, *BARS)
    if next_bars is None:
        next_bars = resampled(bars, unit)
    df = indexed(with_series(bars, base_series, g))
    hours = indexed(with_series(next_bars.select(KEY, TIME, *BARS), higher_series, g))
    days = indexed(with_series(resampled(bars, "day").select(KEY, TIME, *BARS), daily_series, g))
    df = cut(df)
    for families in LAYERS:
        for family in families:
            df = family(df, g)
        df = cut(no_scratch(df))
    df = context.at_levels(context.higher(df, cut(hours), cut(days), g, unit), g)
    return df.drop("bar", *[c for c in df.columns if c.startswith("_")])


def feature_names(df: DataFrame) -> list[str]:
    """Every column that is a feature: an explicit list, never whatever is left."""
    return [c for c in df.columns if c not in (KEY, TIME, *BARS)]
