"""Periods and thresholds. All are parameters, so short series can be tested."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # Defaults of the indicators.
    rsi_period: int = 14
    rsi_mean: int = 14
    rsi_band: int = 14
    rsi_band_width: float = 2.0
    wt_n1: int = 10
    wt_n2: int = 21
    wt_signal: int = 4
    wt_high: float = 60.0
    wt_low: float = -60.0
    stoch: tuple[int, int, int] = (14, 3, 3)
    squeeze_bb: tuple[int, float] = (20, 2.0)
    squeeze_kc: tuple[int, float] = (20, 1.5)
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    adx_period: int = 14
    di_window: int = 5
    spread_window: int = 3
    ema_periods: tuple[int, ...] = (9, 21, 50)
    ema_periods_1h: tuple[int, ...] = (9, 21, 50, 100, 200)
    ema_periods_1d: tuple[int, ...] = (20, 50, 200)
    atr_period: int = 14
    atr_short: int = 5
    atr_rank: int = 100
    atr_window: int = 5
    bb: tuple[int, float] = (20, 2.0)
    vfi_period: int = 130
    vfi_coef: float = 0.2
    vfi_cap: float = 2.5
    vfi_signal: int = 5
    vwap_band: int = 20
    touch_percent: float = 0.1
    williams: int = 14
    cci: int = 20
    cmo: int = 14
    roc: int = 10
    tsi_long: int = 25
    tsi_short: int = 13
    fractal: int = 5
    hurst: int = 100
    fractal_dim: int = 50
    parkinson: int = 20
    kama: tuple[int, int, int] = (10, 2, 30)
    dema_period: int = 21
    sar: tuple[float, float, float] = (0.02, 0.02, 0.2)
    ichimoku: tuple[int, int, int] = (9, 26, 52)
    rsi_levels: tuple[float, float, float] = (70.0, 30.0, 50.0)
    stoch_levels: tuple[float, float] = (80.0, 20.0)
    adx_levels: tuple[float, float] = (25.0, 15.0)
    volume_spike: float = 3.0
    # Labels and trading.
    tp_atr: float = 4.0
    sl_atr: float = 4.0
    horizon: int = 48
    min_profit: float = 0.5
    min_profit_of: dict[str, float] = field(default_factory=lambda: {"BTC": 0.5, "SOL": 0.8, "LINK": 0.7, "TAO": 1.0, "HYPE": 1.0})
    threshold: float = 0.65
    cost: float = 0.0011
    #: Causal: a bar knows its day only up to itself. Whole-day ranges, as in older feature sets, look ahead.
    causal: bool = True


DEFAULT = Config()
