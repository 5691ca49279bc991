"""Zones of price, indicators that learn, and further trails."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidewheel.features import learned, zones
from tidewheel.functions import exprs as x
from tidewheel.operators import recursive
from tidewheel.operators.bars import from_ticks
from tidewheel.plans.config import DEFAULT
from tidewheel.queries.base import HOURLY, LAG, SOFAR, c, daily, full, hourly, lag, over, query, r6, select, shown, table
from tidewheel.queries.kit import TR

N = 5
BLOCKS = f"""w AS (SELECT *, {lag('high', N)} AS h, {lag('low', N)} AS l, max(high) {over(N)} AS hi, min(low) {over(N)} AS lo, count(volume) {over(2 * N + 1)} = {2 * N + 1} AND {lag('volume', N)} = max(volume) {over(2 * N + 1)} AS peak FROM b),
 f AS (SELECT *, CASE WHEN h > hi THEN 0 WHEN l < lo THEN 1 END AS far FROM w), s AS (SELECT *, coalesce(last_value(far IGNORE NULLS) {SOFAR}, 0) AS side FROM f),
 o AS (SELECT symbol, bar, ts, side, CASE side WHEN 1 THEN (h + l) / 2 ELSE h END AS top, CASE side WHEN 1 THEN l ELSE (h + l) / 2 END AS bottom FROM s WHERE peak),
 k AS (SELECT o.symbol, o.bar, min(s.bar) AS broken FROM o JOIN s ON s.symbol = o.symbol AND s.bar >= o.bar AND CASE o.side WHEN 1 THEN s.lo < o.bottom ELSE s.hi > o.top END GROUP BY o.symbol, o.bar)"""


@query("order_blocks", f"WITH {HOURLY}, {BLOCKS} SELECT o.symbol, o.bar AS id, CASE side WHEN 1 THEN 'bull' ELSE 'bear' END AS kind, ts, o.bar, o.bar - {N} AS from_bar, {r6('top')} AS top, {r6('bottom')} AS bottom, broken AS broken_bar FROM o LEFT JOIN k ON k.symbol = o.symbol AND k.bar = o.bar")
def order_blocks(s, d):
    """Order blocks of hourly bars and the bars that break them."""
    return zones.order_blocks(hourly(s, d), N, chunk=64)


@query("open_blocks", f"""WITH {HOURLY}, {BLOCKS}, e AS (SELECT o.symbol, side, o.bar, coalesce(broken, 1000000000) AS until FROM o LEFT JOIN k ON k.symbol = o.symbol AND k.bar = o.bar)
 SELECT b.symbol, b.ts, count(e.bar) FILTER (side = 1) AS open_bull_blocks, count(e.bar) FILTER (side = 0) AS open_bear_blocks FROM b LEFT JOIN e ON e.symbol = b.symbol AND b.bar >= e.bar AND b.bar < e.until GROUP BY b.symbol, b.ts""")
def open_blocks(s, d):
    """How many order blocks are open after each hourly bar."""
    bars = hourly(s, d)
    return shown(zones.with_blocks(bars, zones.order_blocks(bars, N)), "open_bull_blocks", "open_bear_blocks")


def swing(v: str, top: bool) -> str:
    return f"count({v}) {over(2 * N + 1)} = {2 * N + 1} AND {lag(v, N)} = {'max' if top else 'min'}({v}) {over(2 * N + 1)}"


SWINGS = f"""m AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, max(value) AS high, min(value) AS low, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2),
 w AS (SELECT symbol, {lag('ts', N)} AS ts, {lag('open', N)} AS o, {lag('high', N)} AS h, {lag('low', N)} AS l, {lag('close', N)} AS c, {swing('high', True)} AS up, {swing('low', False)} AS down FROM b),
 z AS (SELECT symbol, 'high' AS kind, ts, h AS top, greatest(o, c) AS bottom FROM w WHERE up UNION ALL SELECT symbol, 'low', ts, least(o, c), l FROM w WHERE down),
 n AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY symbol, kind ORDER BY ts), '2100-01-01'::TIMESTAMP) AS until FROM z),
 k AS (SELECT n.symbol, n.kind, n.ts, count(*) AS count FROM n JOIN b ON b.symbol = n.symbol AND b.ts > n.ts AND b.ts < n.until AND b.low < n.top AND b.high > n.bottom GROUP BY ALL),
 v AS (SELECT n.symbol, n.kind, n.ts, sum(m.volume) AS volume FROM n JOIN m ON m.symbol = n.symbol AND m.ts >= n.ts + INTERVAL 1 HOUR AND m.ts < n.until AND m.low < n.top AND m.high > n.bottom GROUP BY ALL)"""


@query("liquidity_zones", f"WITH {HOURLY}, {SWINGS} SELECT n.symbol, n.kind, n.ts, {r6('top')} AS top, {r6('bottom')} AS bottom, coalesce(k.count, 0) AS count, {r6('coalesce(v.volume, 0)')} AS volume FROM n LEFT JOIN k ON k.symbol = n.symbol AND k.kind = n.kind AND k.ts = n.ts LEFT JOIN v ON v.symbol = n.symbol AND v.kind = n.kind AND v.ts = n.ts")
def liquidity_zones(s, d):
    """Swing zones of hourly bars, the bars that come back to them, and the volume of the minutes that do."""
    e = table(s, d, "events")
    minutes = from_ticks(e, c("event_type"), c("ts"), c("value"), F.lit(1.0), [c("ts"), c("event_id")], "minute")
    return zones.swing_zones(hourly(s, d), minutes, 3600, N)


def line_sql(name: str, edge: str, sign: int) -> str:
    """CTEs up to ``name``(symbol, bar, line, slope): for each bar the first pair of known pivots whose line no close crosses."""
    y, close = f"{sign} * {edge}", f"{sign} * x.close"
    return f"""{name}0 AS (SELECT symbol, bar - {N} AS pb, bar AS known, {sign} * {lag(edge, N)} AS y FROM b QUALIFY count({edge}) {over(2 * N + 1)} = {2 * N + 1} AND {lag(y, N)} = min({y}) {over(2 * N + 1)}),
 {name}1 AS (SELECT b.symbol, b.bar, p.pb, p.y, row_number() OVER (PARTITION BY b.symbol, b.bar ORDER BY p.known DESC) AS k FROM b JOIN {name}0 p ON p.symbol = b.symbol AND p.known <= b.bar QUALIFY k <= 3),
 {name}2 AS (SELECT u.symbol, u.bar, u.k AS k1, v.k AS k2, v.pb, v.y, (u.y - v.y) / (u.pb - v.pb) AS m FROM {name}1 u JOIN {name}1 v ON v.symbol = u.symbol AND v.bar = u.bar AND v.k > u.k WHERE u.y > v.y),
 {name} AS (SELECT symbol, bar, {sign} * (y + m * (bar - pb)) AS line, {sign} * m AS slope FROM {name}2 q WHERE NOT EXISTS (SELECT 1 FROM b x WHERE x.symbol = q.symbol AND x.bar BETWEEN q.pb AND q.bar AND {close} < q.y + q.m * (x.bar - q.pb) - 1e-9) QUALIFY row_number() OVER (PARTITION BY symbol, bar ORDER BY k1, k2 DESC) = 1)"""


@query("trend_lines", f"WITH {HOURLY}, {line_sql('su', 'low', 1)}, {line_sql('re', 'high', -1)} SELECT b.symbol, b.ts, {', '.join(f'{r6(f"{k}.{x}")} AS {n}_{x}' for k, n in (('su', 'support'), ('re', 'resistance')) for x in ('line', 'slope'))} FROM b LEFT JOIN su ON su.symbol = b.symbol AND su.bar = b.bar LEFT JOIN re ON re.symbol = b.symbol AND re.bar = b.bar")
def trend_lines(s, d):
    """Trend lines of hourly bars through two of the last three pivots that no close since has crossed."""
    return shown(zones.trend_lines(hourly(s, d), N), "support_line", "support_slope", "resistance_line", "resistance_slope")


@query("price_channels")
def price_channels(s, d):
    """Support and resistance channels of daily bars; a loop holds them in the tests."""
    return zones.channels(daily(s, d))


FACTORS = "(SELECT unnest([1.0::DOUBLE, 2.5::DOUBLE, 4.0::DOUBLE]) AS factor)"
GRID = f"""p AS (SELECT *, {TR} AS tr, {lag('close')} AS before FROM b), r(symbol, bar, a) AS (SELECT symbol, bar, tr FROM p WHERE bar = 1 UNION ALL SELECT p.symbol, p.bar, r.a + 0.1::DOUBLE * (p.tr - r.a) FROM r JOIN p ON p.symbol = r.symbol AND p.bar = r.bar + 1),
 q AS (SELECT p.symbol, p.bar, p.close, p.before, (high + low) / 2 + a * factor AS up, (high + low) / 2 - a * factor AS down, factor FROM p JOIN r ON r.symbol = p.symbol AND r.bar = p.bar JOIN {FACTORS} f ON true),
 g(symbol, bar, factor, upper, lower, way, gain, line) AS (SELECT symbol, bar, factor, up, down, 0, 0::DOUBLE, up FROM q WHERE bar = 10
 UNION ALL SELECT symbol, bar, factor, u, l, w, gain + 2.0::DOUBLE / 11 * ((close - before) * sign(before - line) - gain), CASE w WHEN 1 THEN l ELSE u END
   FROM (SELECT q.*, g.gain, g.line, CASE WHEN q.close > g.upper THEN 1 WHEN q.close < g.lower THEN 0 ELSE g.way END AS w, CASE WHEN q.before < g.upper THEN least(q.up, g.upper) ELSE q.up END AS u, CASE WHEN q.before > g.lower THEN greatest(q.down, g.lower) ELSE q.down END AS l FROM g JOIN q ON q.symbol = g.symbol AND q.factor = g.factor AND q.bar = g.bar + 1))"""


@query("trend_grid", f"WITH RECURSIVE {HOURLY}, {GRID} SELECT b.symbol, b.ts, b.bar, f.factor, {r6('g.line')} AS line, coalesce(g.way, 0)::DOUBLE AS trend, {r6('g.gain')} AS perf FROM b JOIN {FACTORS} f ON true LEFT JOIN g ON g.symbol = b.symbol AND g.bar = b.bar AND g.factor = f.factor")
def trend_grid(s, d):
    """A SuperTrend of hourly bars for each of three factors, with what it has earned."""
    return learned.factor_grid(hourly(s, d), [1.0, 2.5, 4.0])


@query("clustered_trend")
def clustered_trend(s, d):
    """A SuperTrend by the factors that do best at each bar; a loop holds it in the tests."""
    return shown(learned.clustered_trend(hourly(s, d)), "cluster_factor", "cluster_line", "cluster_trend")


@query("lorentzian_neighbours")
def lorentzian_neighbours(s, d):
    """What followed the most similar of the last 500 hourly bars; a loop holds it in the tests."""
    bars = hourly(s, d).withColumns({"f1": x.ratio(c("close") - x.sma("close", 20), x.deviation("close", 20)), "f2": x.diff("close", 3) / c("close"), "f3": (c("high") - c("low")) / c("close")})
    return shown(learned.neighbours(bars, ["f1", "f2", "f3"], back=500, chunk=1000), "lorentzian_vote", "lorentzian_signal")


RF_N = 20
FILTER = f"""p AS (SELECT *, abs(close - {lag('close')}) AS d FROM b),
 r(symbol, ts, bar, close, e1, e2) AS (SELECT symbol, ts, bar, close, d, NULL::DOUBLE FROM p WHERE bar = 2 UNION ALL SELECT symbol, ts, bar, close, n1, CASE WHEN bar = {RF_N + 1} THEN n1 ELSE e2 + 1.0::DOUBLE / {RF_N} * (n1 - e2) END
   FROM (SELECT p.symbol, p.ts, p.bar, p.close, r.e2, r.e1 + 2.0::DOUBLE / {RF_N + 1} * (p.d - r.e1) AS n1 FROM r JOIN p ON p.symbol = r.symbol AND p.bar = r.bar + 1)),
 f(symbol, bar, line, way) AS (SELECT symbol, bar, close, 0::DOUBLE FROM r WHERE bar = {3 * RF_N - 1} UNION ALL SELECT symbol, bar, new, CASE WHEN new = line THEN way ELSE sign(new - line) END
   FROM (SELECT r.symbol, r.bar, f.line, f.way, CASE WHEN r.close > f.line THEN greatest(f.line, r.close - 2 * r.e2) ELSE least(f.line, r.close + 2 * r.e2) END AS new FROM f JOIN r ON r.symbol = f.symbol AND r.bar = f.bar + 1))"""


@query("range_filter", f"WITH RECURSIVE {HOURLY}, {FILTER} SELECT b.symbol, b.ts, {r6('f.line')} AS filter, coalesce(f.way, 0) AS direction FROM b LEFT JOIN f ON f.symbol = b.symbol AND f.bar = b.bar")
def range_filter(s, d):
    """A line that follows the close at a distance of its smoothed steps."""

    def make(b, g):
        line, side = recursive.range_filter(b["close"], RF_N, 2.0)
        return {"filter": pd.Series(line), "direction": pd.Series(side)}

    return shown(recursive.with_series(hourly(s, d), make, DEFAULT), "filter", "direction")


HALF = f"""e AS (SELECT *, max(high) {over(2)} AS top, min(low) {over(2)} AS bot, avg(high) {over(2)} AS hm, avg(low) {over(2)} AS lm, {lag('low')} AS l1, {lag('high')} AS h1, first_value(low) {LAG} AS l0, first_value(high) {LAG} AS h0 FROM b),
 h(symbol, bar, trend, down, hl, hh, line) AS (SELECT symbol, bar, 0, false, l0, h0, NULL::DOUBLE FROM e WHERE bar = 1
 UNION ALL SELECT symbol, bar, CASE WHEN td THEN 1 WHEN tu THEN 0 ELSE trend END, CASE WHEN td THEN false WHEN tu THEN true ELSE down END, CASE WHEN tu THEN bot ELSE kl END, CASE WHEN td THEN top ELSE kh END,
   CASE WHEN (td AND trend = 0) OR (tu AND trend = 1) THEN line WHEN td OR (NOT tu AND trend = 1) THEN least(CASE WHEN td THEN top ELSE kh END, line) ELSE greatest(CASE WHEN tu THEN bot ELSE kl END, line) END
   FROM (SELECT *, down AND hm < kl AND close < l1 AS td, NOT down AND lm > kh AND close > h1 AS tu FROM (SELECT e.*, h.trend, h.down, h.line, CASE WHEN h.down THEN greatest(e.bot, h.hl) ELSE h.hl END AS kl, CASE WHEN h.down THEN h.hh ELSE least(e.top, h.hh) END AS kh FROM h JOIN e ON e.symbol = h.symbol AND e.bar = h.bar + 1)))"""


@query("half_trend", f"WITH RECURSIVE {HOURLY}, {HALF} SELECT b.symbol, b.ts, {r6('h.line')} AS line, CASE WHEN b.bar > 1 THEN h.trend END::DOUBLE AS trend FROM b LEFT JOIN h ON h.symbol = b.symbol AND h.bar = b.bar")
def half_trend(s, d):
    """Trends that turn when means of highs or lows leave the extreme held so far."""

    def make(b, g):
        line, side = recursive.half_trend(b)
        return {"line": pd.Series(line), "trend": pd.Series(side)}

    return shown(recursive.with_series(hourly(s, d), make, DEFAULT), "line", "trend")


CROSS = "(({0} > {1} AND {2} <= {3}) OR ({0} < {1} AND {2} >= {3}))"
#: RSI of 6 from bar 7 on, its mean of 5 from bar 11 on, steps of it from bar 12 on, their means of 11 from bars 22 and 32 on.
TRAIL = f"""p AS (SELECT *, close - {lag('close')} AS st FROM b),
 r(symbol, bar, u, v, x, e1, e2, x1) AS (SELECT symbol, bar, greatest(st, 0), greatest(-st, 0), NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM p WHERE bar = 2
 UNION ALL SELECT symbol, bar, nu, nv, nx, n1, CASE WHEN bar = 22 THEN n1 WHEN bar > 22 THEN e2 + 1.0::DOUBLE / 6 * (n1 - e2) END, x FROM (SELECT *, CASE WHEN bar = 12 THEN abs(nx - x) WHEN bar > 12 THEN e1 + 1.0::DOUBLE / 6 * (abs(nx - x) - e1) END AS n1
   FROM (SELECT *, CASE WHEN bar = 7 THEN rs WHEN bar > 7 THEN x + 1.0::DOUBLE / 3 * (rs - x) END AS nx FROM (SELECT *, 100 - 100 / (1 + nu / nullif(nv, 0)) AS rs FROM (SELECT p.symbol, p.bar, r.u + 1.0::DOUBLE / 6 * (greatest(p.st, 0) - r.u) AS nu, r.v + 1.0::DOUBLE / 6 * (greatest(-p.st, 0) - r.v) AS nv, r.x, r.e1, r.e2 FROM r JOIN p ON p.symbol = r.symbol AND p.bar = r.bar + 1))))),
 q(symbol, bar, lo, up, lo1, up1, way) AS (SELECT symbol, bar, x - 3 * e2, x + 3 * e2, NULL::DOUBLE, NULL::DOUBLE, 1 FROM r WHERE bar = 32
 UNION ALL SELECT r.symbol, r.bar, CASE WHEN r.x1 > q.lo AND r.x > q.lo THEN greatest(q.lo, r.x - 3 * r.e2) ELSE r.x - 3 * r.e2 END, CASE WHEN r.x1 < q.up AND r.x < q.up THEN least(q.up, r.x + 3 * r.e2) ELSE r.x + 3 * r.e2 END, q.lo, q.up,
   CASE WHEN {CROSS.format('r.x', 'q.up', 'r.x1', 'q.up1')} THEN 1 WHEN {CROSS.format('q.lo', 'r.x', 'q.lo1', 'r.x1')} THEN -1 ELSE q.way END FROM q JOIN r ON r.symbol = q.symbol AND r.bar = q.bar + 1)"""


@query("strength_trail", f"WITH RECURSIVE {HOURLY}, {TRAIL} SELECT b.symbol, b.ts, {r6('CASE WHEN q.way > 0 THEN q.lo ELSE q.up END')} AS line, coalesce(q.way, 0)::DOUBLE AS trend FROM b LEFT JOIN q ON q.symbol = b.symbol AND q.bar = b.bar")
def strength_trail(s, d):
    """A trailing line behind the smoothed RSI."""

    def make(b, g):
        line, trend = recursive.strength_trail(b["close"])
        return {"line": pd.Series(line), "trend": pd.Series(trend)}

    return shown(recursive.with_series(hourly(s, d), make, DEFAULT), "line", "trend")


FORCE = f"""r(symbol, ts, bar, e1, e2, d1, d2) AS (SELECT symbol, ts, bar, close * 1000, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM b WHERE bar = 1
 UNION ALL SELECT symbol, ts, bar, n1, n2, n1 - e1, n2 - e2 FROM (SELECT *, CASE WHEN bar = 13 THEN n1 WHEN bar > 13 THEN e2 + 1.0::DOUBLE / 7 * (n1 - e2) END AS n2 FROM (SELECT b.symbol, b.ts, b.bar, r.e1, r.e2, r.e1 + 1.0::DOUBLE / 7 * (b.close * 1000 - r.e1) AS n1 FROM r JOIN b ON b.symbol = r.symbol AND b.bar = r.bar + 1))),
 f AS (SELECT *, CASE WHEN bar >= 26 THEN abs(e1 - e2) * pow((d1 + d2) / 2, 3) END AS force FROM r)"""


@query("trend_force", f"WITH RECURSIVE {HOURLY}, {FORCE} {select({'force': f'force / nullif({full("max", "abs(force)", 39)}, 0)'}, 'f')}")
def trend_force(s, d):
    """The trend direction force index."""
    return shown(recursive.with_series(hourly(s, d), lambda b, g: {"force": recursive.trend_force(b["close"])}, DEFAULT), "force")


def placed(x: str, source: str, name: str) -> str:
    """Where x stands among its last ten values, carried over flat ranges."""
    return f"{name}0 AS (SELECT *, 100 * ({x} - {full('min', x, 10)}) / nullif({full('max', x, 10)} - {full('min', x, 10)}, 0) AS z FROM {source}), {name} AS (SELECT symbol, ts, bar, last_value(z IGNORE NULLS) {SOFAR} AS z FROM {name}0)"


def smoothed(source: str, name: str, first: int) -> str:
    """A mean of three, seeded at bar ``first`` and shown from its third value on."""
    return f"{name}0(symbol, ts, bar, e) AS (SELECT symbol, ts, bar, z FROM {source} WHERE bar = {first} UNION ALL SELECT s.symbol, s.ts, s.bar, r.e + 0.5::DOUBLE * (s.z - r.e) FROM {name}0 r JOIN {source} s ON s.symbol = r.symbol AND s.bar = r.bar + 1), {name} AS (SELECT symbol, ts, bar, CASE WHEN bar >= {first + 2} THEN e END AS e FROM {name}0)"


CYCLE = f"""m0(symbol, ts, bar, a, c) AS (SELECT symbol, ts, bar, close, close FROM b WHERE bar = 1 UNION ALL SELECT b.symbol, b.ts, b.bar, r.a + 1.0::DOUBLE / 12 * (b.close - r.a), r.c + 2.0::DOUBLE / 51 * (b.close - r.c) FROM m0 r JOIN b ON b.symbol = r.symbol AND b.bar = r.bar + 1),
 m AS (SELECT *, CASE WHEN bar >= 50 THEN a - c END AS macd FROM m0), {placed('macd', 'm', 'k')}, {smoothed('k', 'd', 59)}, {placed('e', 'd', 'kd')}, {smoothed('kd', 'stc', 70)}"""


@query("trend_cycle", f"WITH RECURSIVE {HOURLY}, {CYCLE} SELECT b.symbol, b.ts, {r6('CASE WHEN stc.e IS NOT NULL THEN least(greatest(stc.e, 0), 100) END')} AS cycle FROM b LEFT JOIN stc ON stc.symbol = b.symbol AND stc.bar = b.bar")
def trend_cycle(s, d):
    """The Schaff trend cycle."""
    return shown(recursive.with_series(hourly(s, d), lambda b, g: {"cycle": recursive.trend_cycle(b["close"])}, DEFAULT), "cycle")
