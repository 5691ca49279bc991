"""Series that depend on their own last value: exponential means, KAMA, SAR.

One grouped-map pass per symbol computes all of them from OHLCV; a symbol's
bars are bounded by its history (about 100,000 a year at five minutes), and
symbols run in parallel.  Everything that can be a window expression is one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewheel.functions.exprs import KEY, TIME


def ema(x: pd.Series, span: float, warm: bool = True) -> pd.Series:
    """Exponential mean seeded by the first value; null until ``span`` values are there, if ``warm``."""
    return x.ewm(span=span, adjust=False, min_periods=int(span) if warm else 0).mean()


def wilder(x: pd.Series, n: int, warm: bool = True) -> pd.Series:
    return x.ewm(alpha=1.0 / n, adjust=False, min_periods=n if warm else 0).mean()


def safe(a: pd.Series, b: pd.Series) -> pd.Series:
    return a / b.mask(b == 0)


def range_of(b: pd.DataFrame) -> pd.Series:
    last = b["close"].shift()
    return pd.concat([b["high"] - b["low"], (b["high"] - last).abs(), (b["low"] - last).abs()], axis=1).max(axis=1)


def rsi(close: pd.Series, n: int) -> pd.Series:
    step = close.diff()
    gain, loss = wilder(step.clip(lower=0), n), wilder(-step.clip(upper=0), n)
    return 100 - 100 / (1 + safe(gain, loss))


def directional(b: pd.DataFrame, n: int) -> tuple[pd.Series, pd.Series, pd.Series]:
    """(DI+, DI-, ADX)."""
    up, down = b["high"].diff(), -b["low"].diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    atr = wilder(range_of(b), n)
    p, m = 100 * safe(wilder(plus, n), atr), 100 * safe(wilder(minus, n), atr)
    return p, m, wilder(100 * safe((p - m).abs(), p + m), n)


def wave_trend(b: pd.DataFrame, n1: int, n2: int) -> pd.Series:
    price = (b["high"] + b["low"] + b["close"]) / 3
    mean = ema(price, n1)
    return ema(safe(price - mean, 0.015 * ema((price - mean).abs(), n1)), n2)


def kama(close: pd.Series, n: int, fast: int, slow: int) -> pd.Series:
    """Kaufman's adaptive mean, seeded with the close at bar n, and again after a gap."""
    x = close.to_numpy()
    efficiency = safe((close - close.shift(n)).abs(), close.diff().abs().rolling(n, min_periods=n).sum())
    a, b = 2.0 / (fast + 1), 2.0 / (slow + 1)
    weight = ((efficiency * (a - b) + b) ** 2).to_numpy()
    out = np.full(len(x), np.nan)
    value = np.nan
    for i in range(n, len(x)):
        value = x[i] if np.isnan(value) else value + weight[i] * (x[i] - value)
        out[i] = value
    return pd.Series(out, close.index)


def stop_and_reverse(high: np.ndarray, low: np.ndarray, start: float, step: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(SAR, direction). One side is worked on; the short side is the long one mirrored."""
    n = len(high)
    sar, side = np.full(n, np.nan), np.zeros(n)
    if n < 2:
        return sar, side
    way = 1.0 if high[1] >= high[0] else -1.0
    # For way 1 the far edge is the high and the near edge the low; for -1 both are negated.
    edges = {1.0: (high, low), -1.0: (-low, -high)}
    far, near = edges[way]
    stop, extreme, pace = near[0], far[1], start
    sar[1], side[1] = way * stop, way
    for i in range(2, n):
        stop = min(stop + pace * (extreme - stop), near[i - 1], near[i - 2])
        if near[i] < stop:
            stop, way = -extreme, -way
            far, near = edges[way]
            extreme, pace = far[i], start
        elif far[i] > extreme:
            extreme, pace = far[i], min(pace + step, most)
        sar[i], side[i] = way * stop, way
    return sar, side


def supertrend(b: pd.DataFrame, n: int = 10, mult: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(line, direction): bands of ATR around the middle that only tighten while the close stays inside."""
    middle, atr = ((b["high"] + b["low"]) / 2).to_numpy(), wilder(range_of(b), n).to_numpy()
    close = b["close"].to_numpy()
    line, side = np.full(len(b), np.nan), np.zeros(len(b))
    upper = lower = np.nan
    way = 1
    for i in range(len(b)):
        if np.isnan(atr[i]):
            continue
        u, v = middle[i] + mult * atr[i], middle[i] - mult * atr[i]
        upper = u if np.isnan(upper) or u < upper or close[i - 1] > upper else upper
        lower = v if np.isnan(lower) or v > lower or close[i - 1] < lower else lower
        way = 1 if close[i] > upper else -1 if close[i] < lower else way
        line[i], side[i] = lower if way > 0 else upper, way
    return line, side


def trailing_stop(b: pd.DataFrame, n: int = 10, mult: float = 2.0) -> np.ndarray:
    """The stop that follows the close at a distance of ATRs and flips when crossed."""
    gap, close = (mult * wilder(range_of(b), n)).to_numpy(), b["close"].to_numpy()
    out, stop = np.full(len(b), np.nan), np.nan
    for i in range(len(b)):
        if np.isnan(gap[i]):
            continue
        if np.isnan(stop):
            stop = close[i] - gap[i]
        elif close[i] > stop and close[i - 1] > stop:
            stop = max(stop, close[i] - gap[i])
        elif close[i] < stop and close[i - 1] < stop:
            stop = min(stop, close[i] + gap[i])
        else:
            stop = close[i] - gap[i] if close[i] > stop else close[i] + gap[i]
        out[i] = stop
    return out


def flow_index(b: pd.DataFrame, period: int, coef: float, cap: float) -> pd.Series:
    """Volume flow index: volume, capped, signed by typical-price moves that clear a volatility cutoff."""
    price = (b["high"] + b["low"] + b["close"]) / 3
    cutoff = coef * np.log(price).diff().rolling(30, min_periods=30).std(ddof=0) * b["close"]
    mean = b["volume"].rolling(period, min_periods=period).mean().shift()
    move = price.diff()
    capped = b["volume"].where(b["volume"] <= mean * cap, mean * cap)
    signed = capped * np.sign(move).where(move.abs() > cutoff, 0.0)
    return (signed.rolling(period, min_periods=period).sum() / mean).rolling(3, min_periods=3).mean()


def base_series(b: pd.DataFrame, cfg) -> dict[str, pd.Series]:
    """All recursive series of the base timeframe."""
    close = b["close"]
    di_plus, di_minus, adx = directional(b, cfg.adx_period)
    line = ema(close, cfg.macd_fast) - ema(close, cfg.macd_slow)
    flow = flow_index(b, cfg.vfi_period, cfg.vfi_coef, cfg.vfi_cap)
    e1 = ema(close, cfg.dema_period)
    e2 = ema(e1, cfg.dema_period)
    e3 = ema(e2, cfg.dema_period)
    step = close.diff()
    slow = lambda x: ema(ema(x, cfg.tsi_long), cfg.tsi_short)
    sar, side = stop_and_reverse(b["high"].to_numpy(), b["low"].to_numpy(), *cfg.sar)
    out = {
        "rsi_14": rsi(close, cfg.rsi_period), "wt1_5min": wave_trend(b, cfg.wt_n1, cfg.wt_n2),
        "macd_line_5min": line, "macd_signal_5min": ema(line, cfg.macd_signal),
        "di_plus": di_plus, "di_minus": di_minus, "adx": adx,
        "atr_14": wilder(range_of(b), cfg.atr_period), "_atr_short": wilder(range_of(b), cfg.atr_short),
        "vfi": flow, "vfi_signal": ema(flow, cfg.vfi_signal),
        "tsi": 100 * safe(slow(step), slow(step.abs())),
        "_kama": kama(close, *cfg.kama), "_dema": 2 * e1 - e2, "_tema": 3 * e1 - 3 * e2 + e3,
        "_sar": pd.Series(sar, b.index), "psar_direction": pd.Series(side, b.index),
    }
    out |= {f"_ema{n}": ema(close, n) for n in cfg.ema_periods}
    return out | {f"_free_ema{n}": ema(close, n, warm=False) for n in (21, 50)}


def higher_series(b: pd.DataFrame, cfg) -> dict[str, pd.Series]:
    """Recursive series of the next timeframe."""
    close = b["close"]
    line = ema(close, cfg.macd_fast) - ema(close, cfg.macd_slow)
    out = {
        "wt1_1h": wave_trend(b, cfg.wt_n1, cfg.wt_n2), "macd_hist_1h": line - ema(line, cfg.macd_signal),
        "adx_1h": directional(b, cfg.adx_period)[2], "vfi_1h": flow_index(b, cfg.vfi_period, cfg.vfi_coef, cfg.vfi_cap),
        "_atr_free": wilder(range_of(b), 14, warm=False),
    }
    out |= {f"_ema{n}_1h": ema(close, n) for n in cfg.ema_periods_1h}
    return out | {f"_free_ema{n}_1h": ema(close, n, warm=False) for n in (50, 200)}


def daily_series(b: pd.DataFrame, cfg) -> dict[str, pd.Series]:
    return {f"_ema{n}_1d": ema(b["close"], n) for n in cfg.ema_periods_1d}


def with_series(bars: DataFrame, make, cfg, names: list[str] | None = None) -> DataFrame:
    """``bars`` with what ``make(frame, cfg)`` gives for each symbol's bars in time order; NaN becomes null."""
    probe = pd.DataFrame({c: [1.0, 2.0] for c in ("open", "high", "low", "close", "volume")})
    names = names or list(make(probe, cfg))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(TIME, kind="stable").reset_index(drop=True)
        made = make(b, cfg)
        out = pd.DataFrame({k: made[k] for k in names}, index=b.index).astype(float)
        return pd.concat([b, out], axis=1)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema] + [f"`{n}` double" for n in names])
    from pyspark.sql import functions as F

    made = bars.groupBy(KEY).applyInPandas(run, schema)
    return made.withColumns({n: F.when(F.isnan(n), None).otherwise(F.col(n)) for n in names})


def range_filter(close: pd.Series, n: int = 100, mult: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(filter, direction): a line that stays put while the close is within a smoothed range of it; direction is that of its last move."""
    width = (mult * ema(ema(close.diff().abs(), n), 2 * n - 1)).to_numpy()
    x = close.to_numpy()
    line, side = np.full(len(x), np.nan), np.zeros(len(x))
    last, way = np.nan, 0.0
    for i in range(len(x)):
        if np.isnan(width[i]):
            continue
        new = x[i] if np.isnan(last) else max(last, x[i] - width[i]) if x[i] > last else min(last, x[i] + width[i])
        way = way if np.isnan(last) or new == last else float(np.sign(new - last))
        last = line[i] = new
        side[i] = way
    return line, side


def half_trend(b: pd.DataFrame, n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(line, trend 0 up or 1 down): the trend turns when the mean of the other edge leaves the extreme that it has held, and the close the last bar.

    The line of the running side only moves with its trend; after a turn it starts from where the other side's was.
    """
    high, low, close = (b[x].to_numpy() for x in ("high", "low", "close"))
    top, bottom = b["high"].rolling(n).max().to_numpy(), b["low"].rolling(n).min().to_numpy()
    high_mean, low_mean = b["high"].rolling(n).mean().to_numpy(), b["low"].rolling(n).mean().to_numpy()
    line, side = np.full(len(b), np.nan), np.full(len(b), np.nan)
    if not len(b):
        return line, side
    # held: the extreme that the next turn is judged by; the wait for a turn down holds a low, that for one up a high.
    trend, waits_down, held_low, held_high = 0, False, low[0], high[0]
    for i in range(n - 1, len(b)):
        before = i - 1 if i else 0
        turned = False
        if waits_down:
            held_low = max(bottom[i], held_low)
            if high_mean[i] < held_low and close[i] < low[before]:
                turned, trend, waits_down, held_high = trend != 1, 1, False, top[i]
        else:
            held_high = min(top[i], held_high)
            if low_mean[i] > held_high and close[i] > high[before]:
                turned, trend, waits_down, held_low = trend != 0, 0, True, bottom[i]
        last = line[i - 1] if i else np.nan
        if not turned:
            edge = held_high if trend else held_low
            last = edge if np.isnan(last) else min(edge, last) if trend else max(edge, last)
        line[i], side[i] = last, trend
    return line, side


def strength_trail(close: pd.Series, n: int = 6, smooth: int = 5, mult: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(line, trend): a trailing line behind the smoothed RSI, at a distance of its smoothed steps; it turns where the RSI crosses the other side's."""
    index = ema(rsi(close, n), smooth)
    gap = (mult * ema(ema(index.diff().abs(), 2 * n - 1), 2 * n - 1)).to_numpy()
    x = index.to_numpy()
    line, trend = np.full(len(x), np.nan), np.zeros(len(x))
    lower = upper = lower1 = upper1 = np.nan  # of the bar before, and of the one before that
    way = 1.0
    for i in range(len(x)):
        if np.isnan(gap[i]):
            continue
        new_lower, new_upper = x[i] - gap[i], x[i] + gap[i]
        if not np.isnan(lower):
            crossed = lambda a, b, a1, b1: (a > b and a1 <= b1) or (a < b and a1 >= b1)
            if crossed(x[i], upper, x[i - 1], upper1):
                way = 1.0
            elif crossed(lower, x[i], lower1, x[i - 1]):
                way = -1.0
            new_lower = max(lower, new_lower) if x[i - 1] > lower and x[i] > lower else new_lower
            new_upper = min(upper, new_upper) if x[i - 1] < upper and x[i] < upper else new_upper
        lower1, upper1, lower, upper = lower, upper, new_lower, new_upper
        line[i], trend[i] = lower if way > 0 else upper, way
    return line, trend


def trend_force(close: pd.Series, n: int = 13, power: int = 3) -> pd.Series:
    """The force of a trend between -1 and 1: how far a mean and its own mean are apart, times the cube of their joint step, by its extreme of ``n * power`` bars."""
    fast = ema(close * 1000, n)
    slow = ema(fast, n)
    force = (fast - slow).abs() * ((fast.diff() + slow.diff()) / 2) ** power
    return safe(force, force.abs().rolling(n * power, min_periods=n * power).max())


def trend_cycle(close: pd.Series, fast: int = 23, slow: int = 50, cycle: int = 10, smooth: int = 3) -> pd.Series:
    """The Schaff cycle: where the difference of two means stands in its own range, smoothed, and once more the same of that; 0 to 100.

    A flat range keeps the place before.
    """

    def place(x: pd.Series) -> pd.Series:
        low, high = x.rolling(cycle, min_periods=cycle).min(), x.rolling(cycle, min_periods=cycle).max()
        return (100 * safe(x - low, high - low)).ffill()

    return ema(place(ema(place(ema(close, fast) - ema(close, slow)), smooth)), smooth).clip(0, 100)
