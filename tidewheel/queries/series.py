"""Recursive series and what is made of them, with SQL that walks the same recursions bar by bar."""

from __future__ import annotations

import re
from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F

from tidewheel.features import context, events, momentum, statistics, volatility, volume
from tidewheel.functions.exprs import indexed
from tidewheel.operators import bars as ops
from tidewheel.operators import recursive
from tidewheel.plans.config import DEFAULT
from tidewheel.queries.base import DAILY, HOURLY, SOFAR, c, daily, full, hourly, lag, over, query, r6, select, shown
from tidewheel.queries.kit import TR


def mean(value: str, x: str, span: float, first: int, wilder: bool = False) -> str:
    """The next value of an exponential mean that is seeded at bar ``first``."""
    a = f"1.0::DOUBLE / {span}" if wilder else f"2.0::DOUBLE / {span + 1}"
    return f"CASE WHEN p.bar < {first} THEN NULL WHEN p.bar = {first} THEN {x} ELSE r.{value} + {a} * ({x} - r.{value}) END"


#: Names of the states, each with its next value; a later one may read the new value of an earlier one as {name}.
STATES = {
    "esa": mean("esa", "p.tp", 10, 1), "de": mean("de", "abs(p.tp - {esa})", 10, 10), "wt": mean("wt", "((p.tp - {esa}) / nullif(0.015::DOUBLE * {de}, 0))", 21, 19),
    "ef": mean("ef", "p.close", 12, 1), "es": mean("es", "p.close", 26, 1), "sg": mean("sg", "({ef} - {es})", 9, 26),
    "ru": mean("ru", "greatest(p.st, 0)", 14, 2, True), "rd": mean("rd", "greatest(-p.st, 0)", 14, 2, True),
    "a": mean("a", "p.tr", 14, 1, True), "dp": mean("dp", "p.pd", 14, 1, True), "dm": mean("dm", "p.md", 14, 1, True),
    "ax": mean("ax", "(100 * abs({dp} / {a} - {dm} / {a}) / nullif({dp} / {a} + {dm} / {a}, 0))", 14, 14, True),
    "e9": mean("e9", "p.close", 9, 1), "e21": mean("e21", "p.close", 21, 1), "e50": mean("e50", "p.close", 50, 1),
    "d2": mean("d2", "{e21}", 21, 21), "d3": mean("d3", "{d2}", 21, 41),
    "s1": mean("s1", "p.st", 25, 2), "s2": mean("s2", "{s1}", 13, 26), "b1": mean("b1", "abs(p.st)", 25, 2), "b2": mean("b2", "{b1}", 13, 26),
    "km": "CASE WHEN p.bar < 11 THEN NULL WHEN p.bar = 11 THEN p.close ELSE r.km + pow(p.eff * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2) * (p.close - r.km) END",
}


def series(bars: str, names: tuple[str, ...]) -> str:
    """CTEs up to ``v``: the bars of ``b`` with the named states as features have them, null while they warm up."""
    steps: dict[str, str] = {}
    for k, x in STATES.items():
        for other, made in steps.items():
            x = x.replace("{" + other + "}", f"({made})")
        steps[k] = x
    # States that the wanted ones read are walked with them.
    wanted = {"adx": ("ax", "a", "dp", "dm"), "wt1": ("esa", "de", "wt"), "macd": ("ef", "es", "sg"), "rsi": ("ru", "rd"), "atr": ("a",), "emas": ("e9", "e21", "e50"), "dema": ("e21", "d2", "d3"), "tsi": ("s1", "s2", "b1", "b2"), "kama": ("km",)}
    kept = [k for k in STATES if any(k in wanted[n] for n in names)]
    shows = {
        "adx": "CASE WHEN bar >= 27 THEN ax END AS adx, CASE WHEN bar >= 14 THEN 100 * dp / nullif(a, 0) END AS di_plus, CASE WHEN bar >= 14 THEN 100 * dm / nullif(a, 0) END AS di_minus", "wt1": "CASE WHEN bar >= 39 THEN wt END AS wt1",
        "macd": "CASE WHEN bar >= 26 THEN ef - es END AS line, CASE WHEN bar >= 34 THEN ef - es - sg END AS hist", "rsi": "CASE WHEN bar >= 15 THEN 100 - 100 / (1 + ru / nullif(rd, 0)) END AS rsi", "atr": "CASE WHEN bar >= 14 THEN a END AS atr",
        "emas": "CASE WHEN bar >= 9 THEN e9 END AS m9, CASE WHEN bar >= 21 THEN e21 END AS m21, CASE WHEN bar >= 50 THEN e50 END AS m50", "dema": "CASE WHEN bar >= 41 THEN 2 * e21 - d2 END AS dema, CASE WHEN bar >= 61 THEN 3 * e21 - 3 * d2 + d3 END AS tema",
        "tsi": "CASE WHEN bar >= 38 THEN 100 * s2 / nullif(b2, 0) END AS tsi", "kama": "km AS kama",
    }
    starts = {"esa": "p.tp", "a": "p.tr", "dp": "p.pd", "dm": "p.md"} | dict.fromkeys(("ef", "es", "e9", "e21", "e50"), "p.close")  # of those that begin with bar 1
    return f"""{bars}, p0 AS (SELECT *, (high + low + close) / 3 AS tp, {TR} AS tr, close - {lag('close')} AS st, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM b),
 p AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pd, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS md, abs(close - {lag('close', 10)}) / nullif({full('sum', 'abs(st)', 10)}, 0) AS eff FROM p0),
 r(symbol, ts, bar, {', '.join(kept)}) AS (SELECT p.symbol, p.ts, p.bar, {', '.join(f'({starts.get(k, 'NULL')})::DOUBLE' for k in kept)} FROM p WHERE bar = 1
   UNION ALL SELECT p.symbol, p.ts, p.bar, {', '.join(steps[k] for k in kept)} FROM r JOIN p ON p.symbol = r.symbol AND p.bar = r.bar + 1),
 v AS (SELECT b.*, {', '.join(f's.{x}' for n in names for x in _columns(shows[n]))} FROM b JOIN (SELECT symbol, bar, {', '.join(shows[n] for n in names)} FROM r) s ON s.symbol = b.symbol AND s.bar = b.bar)"""


def _columns(shown_as: str) -> list[str]:
    return re.findall(r" AS (\w+)", shown_as)


def above(x: str, y: str) -> str:
    return f"coalesce({lag(x)} <= {lag(y) if y[0].isalpha() else y} AND {x} > {y}, false)"


def below(x: str, y: str) -> str:
    return f"coalesce({lag(x)} >= {lag(y) if y[0].isalpha() else y} AND {x} < {y}, false)"


def since(condition: str) -> str:
    return f"bar - max(CASE WHEN {condition} THEN bar END) {SOFAR}"


def based(s, d):
    return recursive.with_series(hourly(s, d), recursive.base_series, DEFAULT)


def numbers(df, *names: str):
    return shown(df.withColumns({n: c(n).cast("double") for n in names}), *names)


WAVE = {
    "wt1_5min": "wt1", "wt2_5min": "w2", "wt_hist_5min": "wt1 - w2", "wt1_direction": f"wt1 - {lag('wt1')}", "wt1_accel": f"wt1 - 2 * {lag('wt1')} + {lag('wt1', 2)}",
    "wt_cross_5min": f"{above('wt1', 'w2')}::INT - {below('wt1', 'w2')}::INT", "wt_ob_depth": "CASE WHEN wt1 IS NOT NULL THEN greatest(wt1 - 60, 0) END", "wt_os_depth": "CASE WHEN wt1 IS NOT NULL THEN greatest(-60 - wt1, 0) END",
    "wt_range_pct": f"(wt1 - {full('min', 'wt1', 20)}) / nullif({full('max', 'wt1', 20)} - {full('min', 'wt1', 20)}, 0)",
}
W2 = f"k AS (SELECT *, {full('avg', 'wt1', 4)} AS w2 FROM v)"


@query("wave_trend", f"WITH RECURSIVE {series(HOURLY, ('wt1',))}, {W2} {select(WAVE, 'k')}")
def wave_trend(s, d):
    return numbers(momentum.wave_trend(based(s, d), DEFAULT), *WAVE)


MEANS = {"ema9_dist_pct": "(close - m9) / close * 100", "ema21_dist_pct": "(close - m21) / close * 100", "ema50_dist_pct": "(close - m50) / close * 100", "kama_dist_pct": "(close - kama) / close * 100", "dema_dist_pct": "(close - dema) / close * 100", "tema_dist_pct": "(close - tema) / close * 100", "tsi": "tsi"}


@query("mean_distances", f"WITH RECURSIVE {series(HOURLY, ('emas', 'dema', 'tsi', 'kama'))} {select(MEANS, 'v')}")
def mean_distances(s, d):
    return numbers(momentum.averages(based(s, d), DEFAULT), *MEANS)


TREND = {
    "adx": "adx", "di_spread": "di_plus - di_minus", "adx_direction": f"adx - {lag('adx')}", "adx_accel": f"adx - 2 * {lag('adx')} + {lag('adx', 2)}", "di_plus_roc": f"di_plus - {lag('di_plus', 5)}", "di_minus_roc": f"di_minus - {lag('di_minus', 5)}",
    "di_spread_roc": f"di_plus - di_minus - {lag('di_plus - di_minus', 3)}", "di_convergence": f"abs(di_plus - di_minus) - {lag('abs(di_plus - di_minus)', 5)}", "adx_range_pct": f"(adx - {full('min', 'adx', 20)}) / nullif({full('max', 'adx', 20)} - {full('min', 'adx', 20)}, 0)",
}


@query("trend_strength", f"WITH RECURSIVE {series(HOURLY, ('adx',))} {select(TREND, 'v')}")
def trend_strength(s, d):
    return numbers(momentum.directional(based(s, d), DEFAULT), *TREND)


FLOW = f"""f0 AS (SELECT *, (high + low + close) / 3 AS tp FROM b), f1 AS (SELECT *, ln(tp) - {lag('ln(tp)')} AS lm, tp - {lag('tp')} AS mv, {full('avg', 'volume', 130)} AS av FROM f0),
 f2 AS (SELECT *, 0.2 * {full('stddev_pop', 'lm', 30)} * close AS cut, {lag('av')} AS mean FROM f1), f3 AS (SELECT *, least(volume, 2.5 * mean) * CASE WHEN mean IS NULL THEN NULL WHEN abs(mv) > cut THEN sign(mv) ELSE 0 END AS sv FROM f2),
 f4 AS (SELECT *, {full('sum', 'sv', 130)} / mean AS raw FROM f3), f5 AS (SELECT *, {full('avg', 'raw', 3)} AS vfi FROM f4)"""


@query("volume_flow", f"WITH {HOURLY}, {FLOW} {select({'vfi': 'vfi'}, 'f5')}")
def volume_flow(s, d):
    return numbers(based(s, d), "vfi")


def entries(flag: str, n: int) -> str:
    return full("sum", f"{flag}_in", n)


def entered(flag: str) -> str:
    return f"CASE WHEN {lag(flag)} IS NOT NULL THEN greatest({flag} - {lag(flag)}, 0) END AS {flag}_in"


def begun(flag: str) -> str:
    return f"({flag} = 1 AND coalesce({lag(flag)}, 0) = 0)::INT AS {flag}_on, {flag} = 0 AND {lag(flag)} = 1 AS {flag}_out"


def event_wt(level: int) -> str:
    return f"""{W2}, e0 AS (SELECT *, coalesce(wt1 > {level}, false)::INT AS ob, coalesce(wt1 < -{level}, false)::INT AS os, {above('wt1', 'w2')} AS bull, {below('wt1', 'w2')} AS bear FROM k),
 e1 AS (SELECT *, {entered('ob')}, {entered('os')}, {begun('ob')}, {begun('os')} FROM e0), e2 AS (SELECT *, sum(ob_on) {SOFAR} AS oid, sum(os_on) {SOFAR} AS sid FROM e1),
 e3 AS (SELECT *, max(CASE WHEN ob = 1 THEN wt1 END) OVER (PARTITION BY symbol, oid ORDER BY ts) - {level} AS beyond, -{level} - min(CASE WHEN os = 1 THEN wt1 END) OVER (PARTITION BY symbol, sid ORDER BY ts) AS under FROM e2),
 e4 AS (SELECT *, last_value(beyond IGNORE NULLS) {SOFAR} AS lo, last_value(under IGNORE NULLS) {SOFAR} AS lu FROM e3)"""


WT_MEMORY = {
    "wt_bars_since_ob_exit": since("ob_out"), "wt_bars_since_os_exit": since("os_out"), "wt_bars_since_bull_cross": since("bull"), "wt_bars_since_bear_cross": since("bear"), "wt_ob_count_100": entries("ob", 100), "wt_os_count_100": entries("os", 100),
    "wt_last_ob_depth": "CASE WHEN lo IS NOT NULL THEN greatest(lo, 0) END", "wt_last_os_depth": "CASE WHEN lu IS NOT NULL THEN greatest(lu, 0) END",
}


@query("event_wave_trend", f"WITH RECURSIVE {series(HOURLY, ('wt1',))}, {event_wt(20)} {select(WT_MEMORY, 'e4')}")
def event_wave_trend(s, d):
    """Levels of 20, which hourly bars of events do reach."""
    g = replace(DEFAULT, wt_high=20.0, wt_low=-20.0)
    return numbers(events.wave_trend(momentum.wave_trend(based(s, d), g), g), *WT_MEMORY)


EVENT_RSI = f"""e0 AS (SELECT *, coalesce(rsi > 70, false)::INT AS ob, coalesce(rsi < 30, false)::INT AS os, coalesce(rsi > 50, false)::INT AS up, {above('rsi', '50')} OR {below('rsi', '50')} AS met FROM v),
 e1 AS (SELECT *, {entered('ob')}, {entered('os')} FROM e0)"""
RSI_MEMORY = {"rsi_bars_since_ob": since("ob = 1"), "rsi_bars_since_os": since("os = 1"), "rsi_bars_since_50_cross": since("met"), "rsi_ob_count_100": entries("ob", 100), "rsi_os_count_100": entries("os", 100), "rsi_time_above_50_pct": f"{full('avg', 'up', 50)} * 100"}


@query("event_rsi", f"WITH RECURSIVE {series(HOURLY, ('rsi',))}, {EVENT_RSI} {select(RSI_MEMORY, 'e1')}")
def event_rsi(s, d):
    return numbers(events.rsi(based(s, d), DEFAULT), *RSI_MEMORY)


EVENT_MACD = f"e0 AS (SELECT *, {above('hist', '0')} AS bull, {below('hist', '0')} AS bear, {above('line', '0')} OR {below('line', '0')} AS zero FROM v)"
MACD_MEMORY = {"macd_bars_since_bull_cross": since("bull"), "macd_bars_since_bear_cross": since("bear"), "macd_bars_since_zero_cross": since("zero"), "macd_hist_max_50": full("max", "hist", 50), "macd_hist_min_50": full("min", "hist", 50)}


@query("event_macd", f"WITH RECURSIVE {series(HOURLY, ('macd',))}, {EVENT_MACD} {select(MACD_MEMORY, 'e0')}")
def event_macd(s, d):
    return numbers(events.macd(momentum.macd(based(s, d), DEFAULT), DEFAULT), *MACD_MEMORY)


EVENT_ADX = f"e0 AS (SELECT *, {above('di_plus', 'di_minus')} OR {below('di_plus', 'di_minus')} AS met FROM v)"
ADX_MEMORY = {"adx_bars_since_trend": since("adx > 25"), "adx_bars_since_weak": since("adx < 15"), "di_bars_since_cross": since("met"), "adx_peak_50": full("max", "adx", 50)}


@query("event_directional", f"WITH RECURSIVE {series(HOURLY, ('adx',))}, {EVENT_ADX} {select(ADX_MEMORY, 'e0')}")
def event_directional(s, d):
    return numbers(events.directional(based(s, d), DEFAULT), *ADX_MEMORY)


#: Squeeze state and momentum from bars: the state of bands within bands, and the end of a line fitted to where the close stands.
SQUEEZES = f"""t0 AS (SELECT *, {TR} AS tr, close - (({full('max', 'high', 20)} + {full('min', 'low', 20)}) / 2 + {full('avg', 'close', 20)}) / 2 AS off FROM b),
 t1 AS (SELECT *, {full('avg', 'close', 20)} AS bm, {full('stddev_pop', 'close', 20)} AS bs, {full('avg', 'tr', 20)} AS br, CASE WHEN count(off) {over(20)} = 20 THEN list(off) {over(20)} END AS offs FROM t0),
 t2 AS (SELECT *, 4 * bs / nullif(bm, 0) * 100 AS bw, coalesce(bm + 2 * bs < bm + 1.5 * br AND bm - 2 * bs > bm - 1.5 * br, false) AS inside, 3 * list_sum(list_transform(offs, lambda v, i: v * i)) / 210 - 2 * list_avg(offs) AS m FROM t1),
 sz AS (SELECT *, (NOT inside AND coalesce({lag('inside')}, false))::INT AS fire, inside::INT AS sq FROM t2)"""
EVENT_SQUEEZE = f"e1 AS (SELECT *, sum(fire) {SOFAR} AS fires, CASE WHEN sq = 0 AND {lag('sq')} = 1 THEN 1 END AS ends FROM sz), e2 AS (SELECT *, bar - max(CASE WHEN sq = 0 THEN bar END) {SOFAR} AS run FROM e1), e3 AS (SELECT *, CASE WHEN ends = 1 THEN coalesce({lag('run')}, {lag('bar')}) END AS ended FROM e2)"
SQUEEZE_MEMORY = {"squeeze_bars_since_fire": since("fire = 1"), "squeeze_count_200": full("sum", "fire", 200), "squeeze_momentum_at_fire": f"last_value(CASE WHEN fire = 1 THEN m END IGNORE NULLS) {SOFAR}", "squeeze_mom_peak_since_fire": "max(abs(m)) OVER (PARTITION BY symbol, fires ORDER BY ts)", "squeeze_duration_last": f"last_value(ended IGNORE NULLS) {SOFAR}"}


def squeezed(df):
    """Bars with volatility and squeeze momentum."""
    return momentum.squeeze_momentum(volatility.volatility(df, DEFAULT), DEFAULT)


@query("event_squeeze", f"WITH {HOURLY}, {SQUEEZES}, {EVENT_SQUEEZE} {select(SQUEEZE_MEMORY, 'e3')}")
def event_squeeze(s, d):
    """What is remembered of squeezes of hourly bars: releases, momentum at them and since, lengths."""
    return numbers(events.squeeze(squeezed(based(s, d)), DEFAULT), *SQUEEZE_MEMORY)


LAGGED = {
    "rsi_5bar_ago": lag("rsi", 5), "wt1_slope_5bar": f"(wt1 - {lag('wt1', 5)}) / 5", "adx_slope_5bar": f"(adx - {lag('adx', 5)}) / 5", "atr_slope_5bar": f"(atr - {lag('atr', 5)}) / nullif({lag('atr', 5)}, 0) * 100",
    "volume_slope_5bar": f"(v3 - {lag('v3', 5)}) / nullif({lag('v3', 5)}, 0) * 100", "di_spread_change_5bar": f"di_plus - di_minus - {lag('di_plus - di_minus', 5)}",
    "vwap_slope_5bar": f"(vw - {lag('vw', 5)}) / nullif({lag('vw', 5)}, 0) * 100", "squeeze_mom_slope": f"(m - {lag('m', 3)}) / 3",
}
PRICED = "sum((high + low + close) / 3 * volume) OVER d / nullif(sum(volume) OVER d, 0) AS vw"
TODAY = "WINDOW d AS (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("lagged_dynamics", f"WITH RECURSIVE {series(HOURLY, ('rsi', 'wt1', 'adx', 'atr'))}, {SQUEEZES}, k AS (SELECT v.*, sz.m, {full('avg', 'v.volume', 3).replace('BY symbol ORDER BY ts', 'BY v.symbol ORDER BY v.ts')} AS v3 FROM v JOIN sz ON sz.symbol = v.symbol AND sz.bar = v.bar), y AS (SELECT *, {PRICED} FROM k {TODAY}) {select(LAGGED, 'y')}")
def lagged_dynamics(s, d):
    df = volume.vwap(squeezed(momentum.directional(based(s, d), DEFAULT)), DEFAULT)
    return numbers(context.lagged(df, DEFAULT), *LAGGED)


def percentile(x: str, values: str, n: int) -> str:
    """The rank of x among the last n values, in percent; ties share their mean rank."""
    return f"CASE WHEN len({values}) = {n} THEN (len(list_filter({values}, lambda q: q < {x})) + (len(list_filter({values}, lambda q: q = {x})) + 1) / 2.0::DOUBLE) / {n} * 100 END"


REGIME = f"""k0 AS (SELECT v.*, sz.bw FROM v JOIN sz ON sz.symbol = v.symbol AND sz.bar = v.bar), k1 AS (SELECT *, list(bw) FILTER (bw IS NOT NULL) {over(100)} AS bws, list(atr) FILTER (atr IS NOT NULL) {over(DEFAULT.atr_rank)} AS atrs FROM k0),
 k2 AS (SELECT *, {percentile('bw', 'bws', 100)} AS bp, {percentile('atr', 'atrs', DEFAULT.atr_rank)} AS ap, {full('sum', 'atr', 14)} / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0) AS q FROM k1),
 k AS (SELECT *, coalesce(adx > 25 AND abs(di_plus - di_minus) > 10, false) AS trending, coalesce(adx < 20 AND bp < 30, false) AS ranging, coalesce(ap > 80, false) AS volatile, coalesce(ap < 20, false) AS quiet FROM k2),
 g AS (SELECT *, CASE WHEN trending THEN 1 WHEN volatile THEN 2 WHEN quiet THEN 3 WHEN ranging THEN 4 ELSE 0 END AS g FROM k), n AS (SELECT *, coalesce(g <> {lag('g')}, true) AS fresh FROM g)"""
REGIMES = {"regime_trending": "trending::INT", "regime_ranging": "ranging::INT", "regime_volatile": "volatile::INT", "regime_quiet": "quiet::INT", "bars_in_current_regime": f"bar - max(CASE WHEN fresh THEN bar END) {SOFAR} + 1", "choppiness_index": "CASE WHEN q > 0 THEN 100 * log10(q) / log10(14) END"}


@query("market_regime", f"WITH RECURSIVE {series(HOURLY, ('adx', 'atr'))}, {SQUEEZES}, {REGIME} {select(REGIMES, 'n')}")
def market_regime(s, d):
    """Regimes by trend strength and the ranks of band width and true range."""
    return numbers(statistics.regime(volatility.volatility(based(s, d), DEFAULT), DEFAULT), *REGIMES)


WEEKS = f"""{DAILY.replace('b AS (', 'days AS (', 1)}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar FROM (SELECT symbol, date_trunc('week', ts)::TIMESTAMP AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM days GROUP BY 1, 2))"""
NEXT = f"""k AS (SELECT *, (close - m9) / close * 100 AS d9, (close - m21) / close * 100 AS d21, (close - m50) / close * 100 AS d50, hist - {lag('hist')} AS hd, wt1 AS w1, {full('avg', 'wt1', 4)} AS w2 FROM v),
 l AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS t0, {', '.join(f'{lag(n)} AS p_{n}' for n in ('d9', 'd21', 'd50', 'hist', 'hd', 'adx', 'w1', 'w2'))} FROM k)"""
HIGHER = {"ema9_1h_dist_pct": "p_d9", "ema21_1h_dist_pct": "p_d21", "ema50_1h_dist_pct": "p_d50", "macd_hist_1h": "p_hist", "macd_hist_1h_direction": "p_hd", "adx_1h": "p_adx", "wt1_1h": "p_w1", "wt2_1h": "p_w2"}


@query("higher_timeframe", f"WITH RECURSIVE {series(WEEKS, ('emas', 'macd', 'adx', 'wt1'))}, {NEXT} SELECT q.symbol, q.ts, {', '.join(f'{r6(f"l.{x}")} AS {n}' for n, x in HIGHER.items())} FROM days q LEFT JOIN l ON l.symbol = q.symbol AND l.ts = date_trunc('week', q.ts)::TIMESTAMP")
def higher_timeframe(s, d):
    """What daily bars know of the last finished week."""
    df = daily(s, d)
    weeks = indexed(recursive.with_series(ops.resampled(df, "week").select("symbol", "ts", "open", "high", "low", "close", "volume"), recursive.higher_series, DEFAULT))
    made, names = context.higher_columns(weeks, DEFAULT)
    return numbers(ops.previous_higher(df, made, names, "week"), *HIGHER)


SAR = f"""w AS (SELECT *, {lag('high')} AS h1, {lag('low')} AS l1, {lag('high', 2)} AS h2, {lag('low', 2)} AS l2 FROM b),
 s(symbol, bar, way, stop, ext, pace) AS (SELECT symbol, bar, CASE WHEN high >= h1 THEN 1 ELSE -1 END, CASE WHEN high >= h1 THEN l1 ELSE -h1 END, CASE WHEN high >= h1 THEN high ELSE -low END, 0.02::DOUBLE FROM w WHERE bar = 2
 UNION ALL SELECT symbol, bar, CASE WHEN near < due THEN -way ELSE way END, CASE WHEN near < due THEN -ext ELSE due END, CASE WHEN near < due THEN CASE way WHEN 1 THEN -low ELSE high END ELSE greatest(far, ext) END, CASE WHEN near < due THEN 0.02::DOUBLE WHEN far > ext THEN least(pace + 0.02::DOUBLE, 0.2::DOUBLE) ELSE pace END
   FROM (SELECT w.symbol, w.bar, w.high, w.low, s.way, s.ext, s.pace, CASE s.way WHEN 1 THEN w.low ELSE -w.high END AS near, CASE s.way WHEN 1 THEN w.high ELSE -w.low END AS far,
     least(s.stop + s.pace * (s.ext - s.stop), CASE s.way WHEN 1 THEN w.l1 ELSE -w.h1 END, CASE s.way WHEN 1 THEN w.l2 ELSE -w.h2 END) AS due FROM s JOIN w ON w.symbol = s.symbol AND w.bar = s.bar + 1))"""
WALKED = {"wt1_5min": "v.wt1", "adx": "v.adx", "tsi": "v.tsi", "vfi": "f5.vfi", "_dema": "v.dema", "_tema": "v.tema", "_kama": "v.kama", "_sar": "s.way * s.stop", "psar_direction": "coalesce(s.way, 0)"}


@query("recursive_series", f"WITH RECURSIVE {series(HOURLY, ('wt1', 'adx', 'tsi', 'dema', 'kama'))}, {FLOW}, {SAR} {select(WALKED, 'v JOIN f5 ON f5.symbol = v.symbol AND f5.bar = v.bar LEFT JOIN s ON s.symbol = v.symbol AND s.bar = v.bar', 'v.symbol, v.ts')}")
def recursive_series(s, d):
    """WaveTrend, ADX, TSI, VFI, double and triple means, adaptive mean and SAR."""
    return shown(based(s, d), *WALKED)


UP, DOWN = "CASE WHEN q.u IS NULL THEN c.up WHEN c.up IS NULL OR q.u < c.up OR c.close > c.up THEN q.u ELSE c.up END", "CASE WHEN q.v IS NULL THEN c.down WHEN c.down IS NULL OR q.v > c.down OR c.close < c.down THEN q.v ELSE c.down END"
TRAILS = f"""p AS (SELECT *, {TR} AS tr FROM b), r(symbol, bar, a) AS (SELECT symbol, bar, tr FROM p WHERE bar = 1 UNION ALL SELECT p.symbol, p.bar, r.a + 0.1::DOUBLE * (p.tr - r.a) FROM r JOIN p ON p.symbol = r.symbol AND p.bar = r.bar + 1),
 q AS (SELECT b.*, 2 * a AS g, (high + low) / 2 + 3 * a AS u, (high + low) / 2 - 3 * a AS v FROM b JOIN (SELECT symbol, bar, CASE WHEN bar >= 10 THEN a END AS a FROM r) r ON r.symbol = b.symbol AND r.bar = b.bar),
 c(symbol, ts, bar, close, warm, up, down, way, st) AS (SELECT symbol, ts, bar, close, false, NULL::DOUBLE, NULL::DOUBLE, 1, NULL::DOUBLE FROM q WHERE bar = 1
 UNION ALL SELECT q.symbol, q.ts, q.bar, q.close, q.u IS NOT NULL, {UP}, {DOWN}, CASE WHEN q.u IS NULL THEN c.way WHEN q.close > {UP} THEN 1 WHEN q.close < {DOWN} THEN -1 ELSE c.way END,
   CASE WHEN q.g IS NULL THEN NULL WHEN c.st IS NULL THEN q.close - q.g WHEN q.close > c.st AND c.close > c.st THEN greatest(c.st, q.close - q.g) WHEN q.close < c.st AND c.close < c.st THEN least(c.st, q.close + q.g) WHEN q.close > c.st THEN q.close - q.g ELSE q.close + q.g END
   FROM c JOIN q ON q.symbol = c.symbol AND q.bar = c.bar + 1)"""


@query("trails", f"WITH RECURSIVE {HOURLY}, {TRAILS} {select({'supertrend': 'CASE WHEN warm THEN CASE WHEN way > 0 THEN down ELSE up END END', 'supertrend_direction': 'CASE WHEN warm THEN way ELSE 0 END', 'trail': 'st'}, 'c')}")
def trails(s, d):
    """SuperTrend and the trailing stop."""

    def make(b, g):
        line, side = recursive.supertrend(b)
        return {"supertrend": pd.Series(line), "supertrend_direction": pd.Series(side), "trail": pd.Series(recursive.trailing_stop(b))}

    return shown(recursive.with_series(hourly(s, d), make, DEFAULT), "supertrend", "supertrend_direction", "trail")


RECOVERY = f"""g0 AS (SELECT symbol, ts, bar, (close - {full('min', 'low', 14)}) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0) * 100 AS f FROM b), g1 AS (SELECT *, {full('avg', 'f', 3)} AS k FROM g0), g2 AS (SELECT *, coalesce(k > 80 OR k < 20, false)::INT AS far FROM g1),
 g3 AS (SELECT *, coalesce(far = 0 AND {lag('far')} = 1, false)::INT AS ex, {lag('k')} AS k1 FROM g2), g4 AS (SELECT *, sum(ex) {SOFAR} AS g FROM g3), g5 AS (SELECT *, first_value(k1) OVER (PARTITION BY symbol, g ORDER BY ts) <= 50 AS up, first_value(bar) OVER (PARTITION BY symbol, g ORDER BY ts) AS i0 FROM g4),
 g6 AS (SELECT *, coalesce(g > 0 AND CASE WHEN up THEN k >= 50 ELSE k <= 50 END, false)::INT AS there FROM g5), g7 AS (SELECT *, CASE WHEN there = 1 AND sum(there) OVER (PARTITION BY symbol, g ORDER BY ts) = 1 THEN bar - i0 END AS sp FROM g6), g8 AS (SELECT symbol, bar, last_value(sp IGNORE NULLS) {SOFAR} AS speed FROM g7)"""
MEMORY = {
    "stoch_recovery_speed": "g8.speed", "wt_last_ob_depth": "CASE WHEN lo IS NOT NULL THEN greatest(lo, 0) END", "wt_last_os_depth": "CASE WHEN lu IS NOT NULL THEN greatest(lu, 0) END", "rsi_bars_since_50_cross": "m.rsi_cross", "rsi_time_above_50_pct": "m.rsi_up * 100",
    "macd_bars_since_bull_cross": "m.macd_cross", "macd_hist_max_50": "m.hist_top",
}
OTHERS = f"m0 AS (SELECT *, {above('rsi', '50')} OR {below('rsi', '50')} AS met, {above('hist', '0')} AS rise, coalesce(rsi > 50, false)::INT AS high_rsi FROM v), m AS (SELECT symbol, bar, {since('met')} AS rsi_cross, {full('avg', 'high_rsi', 50)} AS rsi_up, {since('rise')} AS macd_cross, {full('max', 'hist', 50)} AS hist_top FROM m0)"


@query("event_memory", f"WITH RECURSIVE {series(HOURLY, ('wt1', 'rsi', 'macd'))}, {event_wt(60)}, {RECOVERY}, {OTHERS} {select(MEMORY, 'e4 JOIN g8 ON g8.symbol = e4.symbol AND g8.bar = e4.bar JOIN m ON m.symbol = e4.symbol AND m.bar = e4.bar', 'e4.symbol, e4.ts')}")
def event_memory(s, d):
    """Recovery speed, WaveTrend, RSI and MACD memory over hourly bars."""
    df = momentum.stochastic(momentum.macd(momentum.wave_trend(based(s, d), DEFAULT), DEFAULT), DEFAULT)
    return numbers(events.macd(events.rsi(events.wave_trend(events.stochastic(df, DEFAULT), DEFAULT), DEFAULT), DEFAULT), *MEMORY)
