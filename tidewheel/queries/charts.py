"""Chart indicators over hourly bars."""

from __future__ import annotations

from tidewheel.features import charts
from tidewheel.operators import recursive
from tidewheel.plans.config import DEFAULT
from tidewheel.queries.base import HOURLY, SOFAR, c, full, hourly, lag, over, query, r6, select, shown
from tidewheel.queries.kit import TR


def numbers(df, names):
    return shown(df.withColumns({n: c(n).cast("double") for n in names}), *names)


def side(up: str, down: str) -> str:
    return f"CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END"


def walked(states: dict[str, tuple[str, str]]) -> str:
    """Exponential means over ``p``: name to (expression, step)."""
    return f"""p AS (SELECT *, {TR} AS tr FROM b), r(symbol, bar, {', '.join(states)}) AS (SELECT symbol, bar, {', '.join(f'({x})::DOUBLE' for x, _ in states.values())} FROM p WHERE bar = 1
 UNION ALL SELECT p.symbol, p.bar, {', '.join(f'r.{k} + {a} * (p.{x} - r.{k})' for k, (x, a) in states.items())} FROM r JOIN p ON p.symbol = r.symbol AND p.bar = r.bar + 1), v AS (SELECT b.*, {', '.join(f'r.{k}' for k in states)} FROM b JOIN r ON r.symbol = b.symbol AND r.bar = b.bar)"""


EMA = {f"e{n}": ("close", f"2.0::DOUBLE / {n + 1}") for n in (3, 8, 9, 20, 21, 40, 50)}
WILD = {f"w{n}": ("tr", f"1.0::DOUBLE / {n}") for n in (5, 100)}


def wma(x: str, n: int) -> str:
    """From a list column of the last n values."""
    return f"CASE WHEN len({x}) = {n} THEN list_inner_product({x}, [i::DOUBLE FOR i IN range(1, {n + 1})]) / {n * (n + 1) / 2} END"


def last(x: str, n: int) -> str:
    return f"list({x}) FILTER ({x} IS NOT NULL) {over(n)}"


CROSS = {"ema_pair": side("e9 > e21", "e9 < e21"), "ema_triple": side("e9 > e21 AND e21 > e50", "e9 < e21 AND e21 < e50"), "wolf_spread": "(e3 - e8) * 1.001"}


@query("ema_order", f"WITH RECURSIVE {HOURLY}, {walked(EMA)} {select(CROSS, 'v')}")
def ema_order(s, d):
    return numbers(charts.crosses(recursive.with_series(hourly(s, d), charts.chart_series, DEFAULT)), CROSS)


DONCHIAN = f"q AS (SELECT *, {full('max', 'high', 15)} AS hi, {full('min', 'low', 15)} AS lo FROM b), k AS (SELECT *, CASE WHEN close > {lag('hi')} THEN 1 WHEN close < {lag('lo')} THEN -1 END AS o FROM q)"


@query("donchian_trend", f"WITH {HOURLY}, {DONCHIAN} {select({'donchian_trend': f'coalesce(last_value(o IGNORE NULLS) {SOFAR}, 0)'}, 'k')}")
def donchian_trend(s, d):
    return numbers(charts.donchian(hourly(s, d)), ["donchian_trend"])


POWER = {"bull_power": "bull", "bear_power": "bear", "power_direction": side("bear < 2", "bull < 2")}


@query("bull_bear_power", f"WITH RECURSIVE {HOURLY}, {walked(WILD)}, k AS (SELECT *, (close - {full('min', 'low', 50)}) / nullif(w5, 0) AS bull, ({full('max', 'high', 50)} - close) / nullif(w5, 0) AS bear FROM v) {select(POWER, 'k')}")
def bull_bear_power(s, d):
    return numbers(charts.power(recursive.with_series(hourly(s, d), charts.chart_series, DEFAULT)), POWER)


@query("detrended_price", f"WITH {HOURLY}, k AS (SELECT *, {full('avg', 'close', 10)} AS m FROM b) {select({'dpo': f'close - {lag("m", 6)}'}, 'k')}")
def detrended_price(s, d):
    return numbers(charts.detrended(hourly(s, d)), ["dpo"])


CYCLE = f"""m AS (SELECT *, {full('avg', 'close', 20)} AS m FROM b), q AS (SELECT *, (m - close) / (m + close / 2) AS p FROM m), l AS (SELECT *, {last('p', 6)} AS l FROM q), w AS (SELECT *, {wma('l', 6)} AS w FROM l),
 k AS (SELECT *, -(w + {full('avg', 'w', 2)}) AS j FROM w)"""


@query("band_cycle", f"WITH {HOURLY}, {CYCLE} {select({'bb_cycle': 'j', 'bb_cycle_trigger': full('avg', 'j', 4)}, 'k')}")
def band_cycle(s, d):
    return numbers(charts.band_cycle(hourly(s, d)), ["bb_cycle", "bb_cycle_trigger"])


@query("ssl_channel", f"WITH {HOURLY}, k AS (SELECT *, CASE WHEN close > {full('avg', 'high', 10)} THEN 1 WHEN close < {full('avg', 'low', 10)} THEN -1 END AS o FROM b) {select({'ssl_direction': f'last_value(o IGNORE NULLS) {SOFAR}'}, 'k')}")
def ssl_channel(s, d):
    return numbers(charts.channel_side(hourly(s, d)), ["ssl_direction"])


BLAST = f"q AS (SELECT *, e20 - e40 AS line, 4 * {full('stddev_pop', 'close', 20)} AS width, 3.7 * w100 AS dead FROM v), k AS (SELECT *, (line - {lag('line')}) * 150 AS t FROM q)"
BLASTS = {"wae_trend": "t", "wae_width": "width", "wae_dead": "dead", "wae_direction": side("t > width AND width > dead AND t > dead", "-t > width AND width > dead AND -t > dead")}


@query("volatility_explosion", f"WITH RECURSIVE {HOURLY}, {walked(EMA | WILD)}, {BLAST} {select(BLASTS, 'k')}")
def volatility_explosion(s, d):
    return numbers(charts.explosion(recursive.with_series(hourly(s, d), charts.chart_series, DEFAULT)), BLASTS)


VORTEX = {"vortex_plus": f"{full('sum', 'up', 14)} / nullif({full('sum', 'tr', 14)}, 0)", "vortex_minus": f"{full('sum', 'dn', 14)} / nullif({full('sum', 'tr', 14)}, 0)"}


@query("vortex", f"WITH {HOURLY}, k AS (SELECT *, abs(high - {lag('low')}) AS up, abs(low - {lag('high')}) AS dn, {TR} AS tr FROM b) {select(VORTEX, 'k')}")
def vortex(s, d):
    return numbers(charts.vortex(hourly(s, d)), VORTEX)


AWESOME = {"awesome": "ao", "awesome_change": f"ao - {lag('ao')}", "awesome_accel": f"ao - {full('avg', 'ao', 5)}"}


@query("awesome", f"WITH {HOURLY}, q AS (SELECT *, (high + low) / 2 AS mid FROM b), k AS (SELECT *, {full('avg', 'mid', 5)} - {full('avg', 'mid', 34)} AS ao FROM q) {select(AWESOME, 'k')}")
def awesome(s, d):
    return numbers(charts.awesome(hourly(s, d)), AWESOME)


SPIKE = {"spike_limit": "x", "spike_direction": side("close - open > x", "close - open < -x")}


@query("body_spike", f"WITH {HOURLY}, q AS (SELECT *, close - open AS body FROM b), k AS (SELECT *, {full('stddev_pop', 'body', 100)} AS x FROM q) {select(SPIKE, 'k')}")
def body_spike(s, d):
    return numbers(charts.body_spike(hourly(s, d)), SPIKE)


HULL = f"l AS (SELECT *, {last('close', 55)} AS l55, {last('close', 27)} AS l27 FROM b), q AS (SELECT *, 2 * ({wma('l27', 27)}) - ({wma('l55', 55)}) AS h FROM l), m AS (SELECT *, {last('h', 7)} AS l7 FROM q), k AS (SELECT *, {wma('l7', 7)} AS hull FROM m)"


@query("hull_mean", f"WITH {HOURLY}, {HULL} {select({'hull': 'hull', 'hull_direction': side(f'hull > {lag("hull", 2)}', f'hull < {lag("hull", 2)}')}, 'k')}")
def hull_mean(s, d):
    return numbers(charts.hull(hourly(s, d)), ["hull", "hull_direction"])


HANG = f"""q AS (SELECT b.*, {full('max', 'close', 22)} - 3 * CASE WHEN b.bar >= 22 THEN w END AS lo, {full('min', 'close', 22)} + 3 * CASE WHEN b.bar >= 22 THEN w END AS hi FROM (SELECT b.*, r.w FROM b JOIN r ON r.symbol = b.symbol AND r.bar = b.bar) b),
 c(symbol, ts, bar, close, l, h, way) AS (SELECT symbol, ts, bar, close, lo, hi, 1 FROM q WHERE bar = 1
 UNION ALL SELECT q.symbol, q.ts, q.bar, q.close, CASE WHEN c.close > coalesce(c.l, q.lo) THEN greatest(q.lo, coalesce(c.l, q.lo)) ELSE q.lo END, CASE WHEN c.close < coalesce(c.h, q.hi) THEN least(q.hi, coalesce(c.h, q.hi)) ELSE q.hi END,
  CASE WHEN q.close > coalesce(c.h, q.hi) THEN 1 WHEN q.close < coalesce(c.l, q.lo) THEN -1 ELSE c.way END FROM c JOIN q ON q.symbol = c.symbol AND q.bar = c.bar + 1)"""


@query("chandelier_exit", f"""WITH RECURSIVE {HOURLY}, p AS (SELECT *, {TR} AS tr FROM b), r(symbol, bar, w) AS (SELECT symbol, bar, tr FROM p WHERE bar = 1 UNION ALL SELECT p.symbol, p.bar, r.w + 1.0::DOUBLE / 22 * (p.tr - r.w) FROM r JOIN p ON p.symbol = r.symbol AND p.bar = r.bar + 1),
 {HANG} SELECT symbol, ts, {r6('l')} AS chandelier_long, {r6('h')} AS chandelier_short, {r6('way')} AS chandelier_direction FROM c""")
def chandelier_exit(s, d):
    return numbers(recursive.with_series(hourly(s, d), charts.chart_series, DEFAULT), ["chandelier_long", "chandelier_short", "chandelier_direction"])


KERNEL = f"l AS (SELECT *, {last('close', 26)} AS l FROM b), k AS (SELECT *, CASE WHEN len(l) = 26 THEN list_inner_product(l, w) / list_sum(w) END AS m FROM l, (SELECT [pow(1 + (26 - i) * (26 - i) / 1024.0::DOUBLE, -8) FOR i IN range(1, 27)] AS w))"


@query("kernel_mean", f"WITH {HOURLY}, {KERNEL} {select({'kernel_mean': 'm', 'kernel_direction': side(f'm > {lag("m")}', f'm < {lag("m")}')}, 'k')}")
def kernel_mean(s, d):
    return numbers(charts.kernel(hourly(s, d)), ["kernel_mean", "kernel_direction"])
