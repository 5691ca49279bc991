"""Bars, expressions, rolling statistics and oscillators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewheel.features import candles as candle_features
from tidewheel.features import levels, momentum, statistics, volatility, volume
from tidewheel.functions import exprs as x
from tidewheel.operators import bars as ops
from tidewheel.operators import recursive
from tidewheel.plans.config import DEFAULT
from tidewheel.queries.base import DAILY, HOURLY, LAG, SOFAR, c, daily, full, hourly, lag, over, query, r6, select, shown, table

OHLC = {n: n for n in ("open", "high", "low", "close", "volume")}
DAY_OF_HOURS = """d AS (SELECT symbol, date_trunc('day', ts) AS day, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM b GROUP BY 1, 2)"""


@query("bars_1h", f"WITH {HOURLY} {select(OHLC, 'b')}")
def bars_1h(s, d):
    return shown(hourly(s, d), *OHLC)


@query("bars_1d", f"WITH {HOURLY}, {DAY_OF_HOURS} {select(OHLC, 'd', 'symbol, day AS ts')}")
def bars_1d(s, d):
    return shown(ops.resampled(hourly(s, d)), *OHLC)


@query("bars_day_long", f"WITH {DAILY} {select(OHLC, 'b')}")
def bars_day_long(s, d):
    return shown(daily(s, d), *OHLC)


@query("bars_1w", f"WITH {DAILY} SELECT symbol, date_trunc('week', ts)::TIMESTAMP AS ts, {r6('first(open ORDER BY ts)')} AS open, {r6('max(high)')} AS high, {r6('min(low)')} AS low, {r6('last(close ORDER BY ts)')} AS close, {r6('sum(volume)')} AS volume FROM b GROUP BY 1, 2")
def bars_1w(s, d):
    return shown(ops.resampled(daily(s, d), "week"), *OHLC)


@query("bars_latest_wins", f"SELECT o_custkey, o_orderdate, o_orderkey, {r6('o_totalprice')} AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1")
def bars_latest_wins(s, d):
    return ops.latest_wins(table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderdate"], [c("o_orderkey")])


@query("insert_or_nothing", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= '1998-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < '1998-01-01')")
def insert_or_nothing(s, d):
    o = table(s, d, "orders")
    day = F.lit("1998-01-01").cast("timestamp_ntz")
    return ops.first_wins(o.where(c("o_orderdate") >= day).select("o_custkey"), o.where(c("o_orderdate") < day), ["o_custkey"])


@query("bars_closed_only", f"WITH {HOURLY} {select(OHLC, 'b')} WHERE ts + INTERVAL 1 HOUR <= '2024-01-15 12:30:00'::TIMESTAMP")
def bars_closed_only(s, d):
    now = F.lit("2024-01-15 12:30:00").cast("timestamp_ntz").cast("timestamp")
    return shown(ops.closed_only(hourly(s, d), now, 3600), *OHLC)


@query("hourly_watermark", f"WITH {HOURLY} SELECT symbol, max(ts) AS last_ts, count(*) AS bars FROM b GROUP BY symbol")
def hourly_watermark(s, d):
    return ops.watermarks(hourly(s, d))


@query("bar_gap_detect", f"WITH {HOURLY}, g AS (SELECT symbol, {lag('ts')} AS after_ts, ts AS before_ts FROM b) SELECT symbol, after_ts, before_ts, date_diff('hour', after_ts, before_ts) - 1 AS missing FROM g WHERE date_diff('hour', after_ts, before_ts) > 1")
def bar_gap_detect(s, d):
    return ops.gaps(hourly(s, d), 3600)


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"


@query("true_range", f"WITH {HOURLY} {select({'tr': TR}, 'b')}")
def true_range(s, d):
    return shown(hourly(s, d).withColumn("tr", x.true_range()), "tr")


CROSS = f"""m AS (SELECT *, {full('avg', 'close', 20)} AS m FROM b), k AS (
  SELECT *, CASE WHEN {lag('close')} <= {lag('m')} AND close > m THEN 1 ELSE 0 END AS up, CASE WHEN {lag('close')} >= {lag('m')} AND close < m THEN 1 ELSE 0 END AS down FROM m)"""


@query("crosses", f"WITH {HOURLY}, {CROSS} SELECT symbol, ts, up::BIGINT AS up, down::BIGINT AS down FROM k")
def crosses(s, d):
    df = hourly(s, d).withColumn("m", x.sma("close", 20))
    return shown(df.withColumns({"up": x.crosses_above("close", "m"), "down": x.crosses_below("close", "m")}), "up", "down")


@query("bars_since", f"WITH {HOURLY}, {CROSS} SELECT symbol, ts, bar - max(CASE WHEN up = 1 THEN bar END) {SOFAR} AS since FROM k")
def bars_since(s, d):
    df = hourly(s, d).withColumn("m", x.sma("close", 20))
    df = df.withColumn("up", x.crosses_above("close", "m"))
    return shown(df.withColumn("since", x.bars_since(c("up") == 1)), "since")


@query("streaks", f"""WITH {HOURLY}, g AS (SELECT *, sum(CASE WHEN close > open THEN 0 ELSE 1 END) {SOFAR} AS g FROM b)
SELECT symbol, ts, sum(CASE WHEN close > open THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, g ORDER BY ts)::BIGINT AS bulls FROM g""")
def streaks(s, d):
    return shown(hourly(s, d).withColumn("bulls", x.streak(c("close") > c("open"))), "bulls")


def ranked(n: int) -> str:
    return f"""(SELECT b.symbol, b.ts, CASE WHEN b.bar >= {n} THEN (count(*) FILTER (o.close < b.close) + (count(*) FILTER (o.close = b.close) + 1) / 2.0) / {n} * 100 END AS r
  FROM b JOIN b o ON o.symbol = b.symbol AND o.bar BETWEEN b.bar - {n - 1} AND b.bar GROUP BY b.symbol, b.ts, b.bar, b.close)"""


@query("pct_rank", f"WITH {HOURLY} {select({'rank': 'r'}, ranked(50))}")
def pct_rank(s, d):
    return shown(hourly(s, d).withColumn("rank", x.percent_rank("close", 50)), "rank")


@query("ffill", f"WITH {HOURLY} {select({'last_up': f'last_value(CASE WHEN close > open THEN close END IGNORE NULLS) {SOFAR}'}, 'b')}")
def ffill(s, d):
    return shown(hourly(s, d).withColumn("last_up", x.filled(F.when(c("close") > c("open"), c("close")))), "last_up")


@query("linreg_end", f"WITH {HOURLY} {select({'line': f'CASE WHEN bar >= 20 THEN regr_intercept(close, bar) {over(20)} + regr_slope(close, bar) {over(20)} * bar END'}, 'b')}")
def linreg_end(s, d):
    return shown(hourly(s, d).withColumn("line", x.regression_end("close", 20)), "line")


@query("mean_abs_dev", f"""WITH {HOURLY}, m AS (SELECT *, avg(close) {over(20)} AS m FROM b)
{select({'mad': 'v'}, '(SELECT m.symbol, m.ts, CASE WHEN m.bar >= 20 THEN avg(abs(o.close - m.m)) END AS v FROM m JOIN b o ON o.symbol = m.symbol AND o.bar BETWEEN m.bar - 19 AND m.bar GROUP BY m.symbol, m.ts, m.bar)')}""")
def mean_abs_dev(s, d):
    return shown(hourly(s, d).withColumn("mad", x.mean_deviation("close", 20)), "mad")


ROLL = {"sma20": full("avg", "close", 20), "std20": full("stddev_pop", "close", 20), "low14": full("min", "low", 14), "high14": full("max", "high", 14), "sum5": full("sum", "volume", 5)}


@query("rolling", f"WITH {HOURLY} {select(ROLL, 'b')}")
def rolling(s, d):
    made = {"sma20": x.sma("close", 20), "std20": x.deviation("close", 20), "low14": x.lowest("low", 14), "high14": x.highest("high", 14), "sum5": x.total("volume", 5)}
    return shown(hourly(s, d).withColumns(made), *made)


Z = lambda n: f"(close - {full('avg', 'close', n)}) / nullif({full('stddev_pop', 'close', n)}, 0)"
BB = f"({full('avg', 'close', 20)} - 2 * {full('stddev_pop', 'close', 20)})"
REVERT = {"zscore_20": Z(20), "zscore_50": Z(50), "bb_position": f"(close - {BB}) / nullif(4 * {full('stddev_pop', 'close', 20)}, 0)"} | {f"return_{n}bar": f"(close / nullif({lag('close', n)}, 0) - 1) * 100" for n in (5, 20, 60)} | {"mean_reversion_score": f"CASE WHEN ({Z(50)}) IS NOT NULL AND ({Z(20)}) IS NOT NULL THEN greatest(-3, least(3, (({Z(20)}) + ({Z(50)})) / 2)) END"}


@query("mean_reversion", f"WITH {DAILY} {select(REVERT, 'b')}")
def mean_reversion(s, d):
    df = statistics.mean_reversion(daily(s, d).withColumn("rsi_14", c("close")), DEFAULT)
    return shown(df, *REVERT)


@query("squeeze_state", f"""WITH {HOURLY}, t AS (SELECT *, {TR} AS tr FROM b), s AS (SELECT *, {full('avg', 'close', 20)} AS m, {full('stddev_pop', 'close', 20)} AS sd, {full('avg', 'tr', 20)} AS r FROM t),
 i AS (SELECT *, coalesce(m + 2 * sd < m + 1.5 * r AND m - 2 * sd > m - 1.5 * r, false) AS inside FROM s),
 q AS (SELECT *, CASE WHEN inside THEN -1 WHEN {lag('inside')} THEN 1 ELSE 0 END AS state FROM i)
{select({'bb_width': '4 * sd / nullif(m, 0) * 100', 'kc_width': '3 * r / nullif(m, 0) * 100', 'squeeze_state': 'state', 'bars_since_squeeze_release': f'bar - max(CASE WHEN state = 1 THEN bar END) {SOFAR}', 'high_low_range_pct': '(high - low) / nullif(close, 0) * 100'}, 'q')}""")
def squeeze_state(s, d):
    df = volatility.volatility(hourly(s, d).withColumns({"atr_14": c("high"), "_atr_short": c("low")}), DEFAULT)
    return shown(df.withColumn("bars_since_squeeze_release", c("bars_since_squeeze_release").cast("double")), "bb_width", "kc_width", "squeeze_state", "bars_since_squeeze_release", "high_low_range_pct")


RET = f"r AS (SELECT *, ln(close / {lag('close')}) AS r FROM b)"


@query("realized_vol", f"WITH {DAILY}, {RET}, v AS (SELECT *, {full('stddev_pop', 'r', 5)} AS v5, {full('stddev_pop', 'r', 20)} AS v20 FROM r) {select({'realized_vol_5': 'v5', 'realized_vol_20': 'v20', 'vol_ratio_5_20': 'v5 / nullif(v20, 0)'}, 'v')}")
def realized_vol(s, d):
    df = volatility.volatility(daily(s, d).withColumns({"atr_14": c("high"), "_atr_short": c("low")}), DEFAULT)
    return shown(df, "realized_vol_5", "realized_vol_20", "vol_ratio_5_20")


def corr(k: int) -> str:
    m = 50 - k
    return f"CASE WHEN count(r) {over(50)} = 50 THEN covar_pop(r, l{k}) {over(m)} / nullif(stddev_pop(r) {over(m)} * stddev_pop(l{k}) {over(m)}, 0) END"


@query("statistical", f"""WITH {DAILY}, {RET}, l AS (SELECT *, {lag('r', 1)} AS l1, {lag('r', 5)} AS l5, {full('sum', 'r', 10)} AS r10, pow(ln(high / low), 2) AS hl FROM r)
{select({'autocorrelation_1': corr(1), 'autocorrelation_5': corr(5), 'variance_ratio': f'CASE WHEN count(r) {over(20)} = 20 THEN var_pop(r10) {over(11)} / nullif(10 * var_pop(r) {over(20)}, 0) END', 'parkinson_vol': f'sqrt({full("avg", "hl", 20)} / (4 * ln(2)))', 'skewness_20': full('skewness', 'r', 20), 'kurtosis_20': full('kurtosis', 'r', 20)}, 'l')}""")
def statistical(s, d):
    df = daily(s, d).withColumn("_return", F.ln(x.ratio("close", x.lag("close"))))
    return shown(statistics.statistical(df, DEFAULT), "autocorrelation_1", "autocorrelation_5", "variance_ratio", "parkinson_vol", "skewness_20", "kurtosis_20")


@query("fractal_measures")
def fractal_measures(s, d):
    """Hurst exponent, entropy and box dimension of daily bars."""
    df = daily(s, d).withColumn("_return", F.ln(x.ratio("close", x.lag("close"))))
    return shown(statistics.statistical(df, DEFAULT), "hurst_exponent", "price_entropy", "fractal_dimension")


@query("price_entropy", f"""WITH {DAILY}, {RET}, p AS (
  SELECT a.symbol, a.ts, o.r, min(o.r) OVER w AS lo, max(o.r) OVER w AS hi, count(o.r) OVER w AS n FROM r a JOIN r o ON o.symbol = a.symbol AND o.bar BETWEEN a.bar - 49 AND a.bar WHERE o.r IS NOT NULL WINDOW w AS (PARTITION BY a.symbol, a.ts)
), k AS (SELECT symbol, ts, n, least(floor((r - lo) / ((hi - lo) / 10)), 9) AS b, count(*) AS k FROM p GROUP BY ALL)
SELECT r.symbol, r.ts, {r6('e')} AS price_entropy FROM r LEFT JOIN (SELECT symbol, ts, sum(-k / 50.0 * ln(k / 50.0)) AS e FROM k WHERE n = 50 GROUP BY symbol, ts) USING (symbol, ts)""")
def price_entropy(s, d):
    df = daily(s, d).withColumn("_return", F.ln(x.ratio("close", x.lag("close"))))
    return shown(statistics.with_entropy(df, "_return", 50, "price_entropy"), "price_entropy")


@query("efficiency", f"WITH {HOURLY}, m AS (SELECT *, abs(close - {lag('close')}) AS mv FROM b) {select({'efficiency_ratio': f'abs(close - {lag("close", 14)}) / nullif({full("sum", "mv", 14)}, 0)'}, 'm')}")
def efficiency(s, d):
    df = hourly(s, d).withColumn("mv", F.abs(x.diff("close")))
    return shown(df.withColumn("efficiency_ratio", x.ratio(F.abs(x.diff("close", 14)), x.total("mv", 14))), "efficiency_ratio")


@query("stochastic", f"""WITH {HOURLY}, f AS (SELECT *, (close - {full('min', 'low', 14)}) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0) * 100 AS f FROM b),
 k AS (SELECT *, {full('avg', 'f', 3)} AS k FROM f), d AS (SELECT *, {full('avg', 'k', 3)} AS d FROM k)
{select({'stoch_k': 'k', 'stoch_d': 'd', 'stoch_k_direction': f'k - {lag("k")}', 'stoch_kd_spread': 'k - d', 'stoch_kd_spread_change': f'(k - d) - ({lag("k")} - {lag("d")})', 'stoch_range_pct': 'CASE WHEN k IS NOT NULL THEN greatest(0, least(1, (k - 20) / 60)) END'}, 'd')}""")
def stochastic(s, d):
    return shown(momentum.stochastic(hourly(s, d), DEFAULT), "stoch_k", "stoch_d", "stoch_k_direction", "stoch_kd_spread", "stoch_kd_spread_change", "stoch_range_pct")


@query("oscillators", f"""WITH {HOURLY}, t AS (SELECT *, close - {lag('close')} AS st FROM b), u AS (SELECT *, CASE WHEN st > 0 THEN st WHEN st IS NOT NULL THEN 0 END AS up, CASE WHEN st < 0 THEN -st WHEN st IS NOT NULL THEN 0 END AS dn FROM t)
{select({'williams_r': f'-100 * ({full("max", "high", 14)} - close) / nullif({full("max", "high", 14)} - {full("min", "low", 14)}, 0)', 'cmo_14': f'({full("sum", "up", 14)} - {full("sum", "dn", 14)}) / nullif({full("sum", "up", 14)} + {full("sum", "dn", 14)}, 0) * 100', 'roc_10': f'(close / nullif({lag("close", 10)}, 0) - 1) * 100'}, 'u')}""")
def oscillators(s, d):
    return shown(momentum.further(hourly(s, d), DEFAULT), "williams_r", "cmo_14", "roc_10")


@query("cci", f"""WITH {HOURLY}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM b), m AS (SELECT *, avg(tp) {over(20)} AS m FROM t),
 v AS (SELECT m.symbol, m.ts, any_value(m.tp) - any_value(m.m) AS off, avg(abs(o.tp - m.m)) AS mad, any_value(m.bar) AS bar FROM m JOIN t o ON o.symbol = m.symbol AND o.bar BETWEEN m.bar - 19 AND m.bar GROUP BY m.symbol, m.ts)
{select({'cci_20': 'CASE WHEN bar >= 20 THEN off / nullif(0.015 * mad, 0) END'}, 'v')}""")
def cci(s, d):
    return shown(momentum.further(hourly(s, d), DEFAULT), "cci_20")


def mid(n: int) -> str:
    return f"({full('max', 'high', n)} + {full('min', 'low', n)}) / 2"


@query("ichimoku", f"""WITH {HOURLY}, m AS (SELECT *, {mid(9)} AS t, {mid(26)} AS k, {mid(52)} AS sb FROM b), q AS (SELECT *, lag(((t + k) / 2 + sb) / 2, 26) {LAG} AS cloud FROM m)
{select({'tenkan_dist_pct': '(close - t) / nullif(close, 0) * 100', 'kijun_dist_pct': '(close - k) / nullif(close, 0) * 100', 'tk_cross': 'sign(t - k)', 'tk_spread': '(t - k) / nullif(close, 0) * 100', 'cloud_dist_pct': '(close - cloud) / nullif(close, 0) * 100'}, 'q')}""")
def ichimoku(s, d):
    return shown(momentum.ichimoku(hourly(s, d), DEFAULT), "tenkan_dist_pct", "kijun_dist_pct", "tk_cross", "tk_spread", "cloud_dist_pct")


BUY = "CASE WHEN high > low THEN greatest(0, least(1, (close - low) / (high - low))) END"


@query("volume_pressure", f"""WITH {DAILY}, p AS (SELECT *, {BUY} AS bp, close - {lag('close')} AS st FROM b), q AS (SELECT *, volume * bp - volume * (1 - bp) AS dl, volume * bp / nullif(volume * (1 - bp), 0) AS bs, sum(coalesce(sign(st), 0) * volume) {SOFAR} AS obv FROM p)
{select({'volume_ratio': f'volume / nullif({full("avg", "volume", 20)}, 0)', 'volume_trend': f'{full("avg", "volume", 5)} / nullif({full("avg", "volume", 20)}, 0)', 'buy_volume_pct': 'bp', 'sell_volume_pct': '1 - bp', 'buy_sell_ratio_sma5': full('avg', 'bs', 5), 'cum_delta_5': full('sum', 'dl', 5), 'cum_delta_20': full('sum', 'dl', 20), 'obv_slope': f'(obv - {lag("obv", 10)}) / 10'}, 'q')}""")
def volume_pressure(s, d):
    return shown(volume.pressure(daily(s, d), DEFAULT), "volume_ratio", "volume_trend", "buy_volume_pct", "sell_volume_pct", "buy_sell_ratio_sma5", "cum_delta_5", "cum_delta_20", "obv_slope")


@query("money_flow", f"""WITH {DAILY}, t AS (SELECT *, (high + low + close) / 3 AS tp, CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume END AS mf FROM b),
 u AS (SELECT *, CASE WHEN tp > {lag('tp')} THEN tp * volume ELSE 0 END AS pos, CASE WHEN tp < {lag('tp')} THEN tp * volume ELSE 0 END AS neg, CASE WHEN mf IS NOT NULL THEN sum(mf) {SOFAR} END AS ad FROM t)
{select({'cmf_20': f'{full("sum", "mf", 20)} / nullif({full("sum", "volume", 20)}, 0)', 'mfi_14': f'100 - 100 / (1 + {full("sum", "pos", 14)} / nullif({full("sum", "neg", 14)}, 0))', 'ad_line': 'ad', 'ad_slope_10': f'(ad - {lag("ad", 10)}) / 10'}, 'u')}""")
def money_flow(s, d):
    df = volume.money_flow(daily(s, d).withColumns({"rsi_14": c("close"), "vfi": c("close")}), DEFAULT)
    return shown(df, "cmf_20", "mfi_14", "ad_line", "ad_slope_10")


DAYW = "OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BAND = "OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("vwap", f"""WITH {HOURLY}, v AS (SELECT *, sum((high + low + close) / 3 * volume) {DAYW} / nullif(sum(volume) {DAYW}, 0) AS v, CASE WHEN count(*) {BAND} = 20 THEN stddev_pop(close) {BAND} END AS sd FROM b)
{select({'vwap_daily': 'v', 'vwap_dist_pct': '(close - v) / nullif(close, 0) * 100', 'vwap_slope': f'(v - {lag("v", 5)}) / nullif({lag("v", 5)}, 0) * 100', 'vwap_upper_band': 'v + sd', 'vwap_lower_band': 'v - sd', 'vwap_band_position': '(close - (v - sd)) / nullif(2 * sd, 0)'}, 'v')}""")
def vwap(s, d):
    return shown(volume.vwap(hourly(s, d), DEFAULT), "vwap_daily", "vwap_dist_pct", "vwap_slope", "vwap_upper_band", "vwap_lower_band", "vwap_band_position")


MULT = {"S3": "-1.0", "S2": "-0.618", "S1": "-0.382", "P": "0.0", "R1": "0.382", "R2": "0.618", "R3": "1.0"}


def pivot_sql(bars: str, unit: str, pre: str, near: str, tested: str) -> str:
    cols = [f"{pre}pivot_{k}" for k in MULT]
    lv = ", ".join(f"p + {m} * r AS {n}" for n, m in zip(cols, MULT.values(), strict=True))
    dist = "[" + ", ".join(f"abs({n} - close)" for n in cols) + "]"
    out = {n: n for n in cols} | {
        f"dist_to_nearest{near}_pivot_pct": "abs(close - lvl) / nullif(close, 0) * 100", f"nearest{near}_pivot_type": "idx - 1",
        f"{pre}pivot_zone": f"CASE WHEN {cols[0]} IS NULL THEN -1 WHEN close <= {cols[0]} THEN 0 WHEN close >= {cols[6]} THEN 5 ELSE " + " + ".join(f"(close >= {n})::INT" for n in cols) + " - 1 END",
        f"{pre}pivot_approach_dir": f"CASE WHEN abs(close - lvl) < abs({lag('close - lvl')}) THEN CASE WHEN close > lvl THEN 1 ELSE -1 END ELSE 0 END",
        f"{pre}pivot_approach_speed": f"abs(close - {lag('close', 3)}) / nullif(close, 0) * 100",
        tested: f"sum(CASE WHEN abs(close - lvl) <= lvl * 0.001 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, date_trunc('{unit}', ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    }
    return f"""WITH {bars}, h AS (SELECT symbol, date_trunc('{unit}', ts) AS u, max(high) AS hi, min(low) AS lo, last(close ORDER BY ts) AS cl FROM b GROUP BY 1, 2),
 l AS (SELECT symbol, u, lag(hi) OVER w - lag(lo) OVER w AS r, (lag(hi) OVER w + lag(lo) OVER w + lag(cl) OVER w) / 3 AS p FROM h WINDOW w AS (PARTITION BY symbol ORDER BY u)),
 m AS (SELECT b.*, {lv} FROM b JOIN l ON l.symbol = b.symbol AND l.u = date_trunc('{unit}', b.ts)),
 n AS (SELECT *, CASE WHEN {cols[0]} IS NULL THEN 1 ELSE list_position({dist}, list_min({dist})) END AS idx FROM m), q AS (SELECT *, [{', '.join(cols)}][idx] AS lvl FROM n) {select(out, 'q')}"""


@query("fib_pivots_daily", pivot_sql(HOURLY, "day", "", "", "pivot_times_tested_today"))
def fib_pivots_daily(s, d):
    df = levels.pivots(hourly(s, d), DEFAULT)
    names = [f"pivot_{k}" for k in MULT] + ["dist_to_nearest_pivot_pct", "nearest_pivot_type", "pivot_zone", "pivot_approach_dir", "pivot_approach_speed", "pivot_times_tested_today"]
    return shown(df.withColumns({n: c(n).cast("double") for n in names}), *names)


@query("fib_pivots_weekly", pivot_sql(DAILY, "week", "weekly_", "_weekly", "weekly_pivot_times_tested_this_week"))
def fib_pivots_weekly(s, d):
    df = levels.pivots(daily(s, d), DEFAULT, "week")
    names = [f"weekly_pivot_{k}" for k in MULT] + ["dist_to_nearest_weekly_pivot_pct", "nearest_weekly_pivot_type", "weekly_pivot_zone", "weekly_pivot_approach_dir", "weekly_pivot_approach_speed", "weekly_pivot_times_tested_this_week"]
    return shown(df.withColumns({n: c(n).cast("double") for n in names}), *names)


@query("prev_day_context", f"""WITH {HOURLY}, {DAY_OF_HOURS}, p AS (SELECT symbol, day, open, lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 q AS (SELECT b.symbol, b.ts, b.close, p.open AS o, po, ph, pl, pc, (ph + pl + pc) / 3 AS pp FROM b JOIN p ON p.symbol = b.symbol AND p.day = date_trunc('day', b.ts))
{select({'prev_day_range_pct': '(ph - pl) / nullif(pc, 0) * 100', 'prev_day_close_vs_pivot': '(pc - pp) / nullif(pp, 0) * 100', 'gap_pct': '(o - pc) / nullif(pc, 0) * 100', 'dist_to_prev_day_high_pct': '(close - ph) / nullif(close, 0) * 100', 'dist_to_prev_day_low_pct': '(close - pl) / nullif(close, 0) * 100', 'prev_session_direction': 'sign(pc - po)', 'daily_open_dist_pct': '(close - o) / nullif(o, 0) * 100'}, 'q')}""")
def prev_day_context(s, d):
    df = levels.previous_day(levels.pivots(hourly(s, d), DEFAULT), DEFAULT)
    return shown(df, "prev_day_range_pct", "prev_day_close_vs_pivot", "gap_pct", "dist_to_prev_day_high_pct", "dist_to_prev_day_low_pct", "prev_session_direction", "daily_open_dist_pct")


@query("session_flags", f"""WITH {HOURLY}, h AS (SELECT *, hour(ts) AS h FROM b), f AS (SELECT *, (h >= 21 OR h < 6)::BIGINT AS session_sydney, (h < 9)::BIGINT AS session_tokyo, (h >= 7 AND h < 16)::BIGINT AS session_london, (h >= 13 AND h < 22)::BIGINT AS session_new_york FROM h)
SELECT symbol, ts, session_sydney, session_tokyo, session_london, session_new_york, (h IN (7, 8))::BIGINT AS overlap_tokyo_london, (h IN (13, 14, 15))::BIGINT AS overlap_london_ny, (h = 21)::BIGINT AS overlap_ny_sydney, (h < 6)::BIGINT AS overlap_sydney_tokyo,
  session_sydney + session_tokyo + session_london + session_new_york AS active_session_count,
  h * 60 + minute(ts) - CASE WHEN h >= 21 THEN 1260 WHEN h >= 13 THEN 780 WHEN h >= 7 THEN 420 ELSE 0 END AS minutes_into_session,
  CASE WHEN h >= 21 THEN 1800 WHEN h >= 13 THEN 1320 WHEN h >= 7 THEN 960 ELSE 540 END - (h * 60 + minute(ts)) AS minutes_to_session_close, isodow(ts) - 1 AS day_of_week, (isodow(ts) = 1)::BIGINT AS is_monday FROM f""")
def session_flags(s, d):
    names = ["session_sydney", "session_tokyo", "session_london", "session_new_york", "overlap_tokyo_london", "overlap_london_ny", "overlap_ny_sydney", "overlap_sydney_tokyo", "active_session_count", "minutes_into_session", "minutes_to_session_close", "day_of_week", "is_monday"]
    return shown(levels.sessions(hourly(s, d), DEFAULT), *names)


def session_range_sql(frame: str) -> str:
    return f"""WITH {HOURLY}, {DAY_OF_HOURS}, a AS (SELECT symbol, day, CASE WHEN count(*) OVER w = 20 THEN avg(high - low) OVER w END AS avg20, lag((high - low) / nullif(open, 0) * 100) OVER (PARTITION BY symbol ORDER BY day) AS prev FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT b.symbol, b.ts, {r6(f"(max(b.high) OVER {frame} - min(b.low) OVER {frame}) / nullif(a.avg20, 0)")} AS session_range_vs_avg, {r6('a.prev')} AS prev_session_range_pct FROM b JOIN a ON a.symbol = b.symbol AND a.day = date_trunc('day', b.ts)"""


@query("session_range_causal", session_range_sql("(PARTITION BY b.symbol, date_trunc('day', b.ts) ORDER BY b.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def session_range_causal(s, d):
    return shown(levels.sessions(hourly(s, d), DEFAULT), "session_range_vs_avg", "prev_session_range_pct")


@query("session_range_whole_day", session_range_sql("(PARTITION BY b.symbol, date_trunc('day', b.ts))"))
def session_range_whole_day(s, d):
    return shown(levels.sessions(hourly(s, d), replace(DEFAULT, causal=False)), "session_range_vs_avg", "prev_session_range_pct")


@query("candle_shape", f"""WITH {HOURLY}, w AS (SELECT *, CASE WHEN high > low THEN abs(close - open) / (high - low) END AS bp, CASE WHEN high > low THEN (high - greatest(open, close)) / (high - low) END AS uw, CASE WHEN high > low THEN (least(open, close) - low) / (high - low) END AS lw, {lag('open')} AS po, {lag('close')} AS pc FROM b)
{select({'body_pct': 'bp', 'upper_wick_pct': 'uw', 'lower_wick_pct': 'lw', 'body_vs_prev_body': 'abs(close - open) / nullif(abs(pc - po), 0)', 'engulfing': 'CASE WHEN close > open AND pc < po AND close >= po AND open <= pc THEN 1 WHEN close < open AND pc > po AND close <= po AND open >= pc THEN -1 ELSE 0 END', 'pin_bar': 'CASE WHEN lw > 2 * bp AND uw < bp THEN 1 WHEN uw > 2 * bp AND lw < bp THEN -1 ELSE 0 END'}, 'w')}""")
def candle_shape(s, d):
    names = ["body_pct", "upper_wick_pct", "lower_wick_pct", "body_vs_prev_body", "engulfing", "pin_bar"]
    return shown(candle_features.candles(hourly(s, d), DEFAULT).withColumns({n: c(n).cast("double") for n in names[4:]}), *names)


def chain(steps: str, seed: str, cols: str) -> str:
    """A recursion over bars in order; DuckDB walks it one bar of every symbol at a time."""
    return f"r({cols}) AS (SELECT {seed} FROM b WHERE bar = 1 UNION ALL SELECT {steps} FROM r JOIN b ON b.symbol = r.symbol AND b.bar = r.bar + 1)"


@query("ema", f"WITH RECURSIVE {HOURLY}, " + chain("b.symbol, b.ts, b.bar, r.e9 + 0.2 * (b.close - r.e9), r.e21 + 2.0::DOUBLE / 22 * (b.close - r.e21)", "symbol, ts, bar, close, close", "symbol, ts, bar, e9, e21") + f" {select({'ema9': 'CASE WHEN bar >= 9 THEN e9 END', 'ema21': 'CASE WHEN bar >= 21 THEN e21 END'}, 'r')}")
def ema(s, d):
    df = recursive.with_series(hourly(s, d), lambda b, g: {"ema9": recursive.ema(b["close"], 9), "ema21": recursive.ema(b["close"], 21)}, DEFAULT)
    return shown(df, "ema9", "ema21")


@query("macd", f"WITH RECURSIVE {HOURLY}, " + chain("b.symbol, b.ts, b.bar, r.f + 2.0::DOUBLE / 13 * (b.close - r.f), r.s + 2.0::DOUBLE / 27 * (b.close - r.s), CASE WHEN b.bar < 26 THEN NULL WHEN b.bar = 26 THEN (r.f + 2.0::DOUBLE / 13 * (b.close - r.f)) - (r.s + 2.0::DOUBLE / 27 * (b.close - r.s)) ELSE r.g + 0.2 * ((r.f + 2.0::DOUBLE / 13 * (b.close - r.f)) - (r.s + 2.0::DOUBLE / 27 * (b.close - r.s)) - r.g) END", "symbol, ts, bar, close, close, NULL::DOUBLE", "symbol, ts, bar, f, s, g") + f" {select({'macd_line_5min': 'CASE WHEN bar >= 26 THEN f - s END', 'macd_signal_5min': 'CASE WHEN bar >= 34 THEN g END', 'macd_hist_5min': 'CASE WHEN bar >= 34 THEN f - s - g END'}, 'r')}")
def macd(s, d):
    df = recursive.with_series(hourly(s, d), recursive.base_series, DEFAULT)
    return shown(momentum.macd(df, DEFAULT), "macd_line_5min", "macd_signal_5min", "macd_hist_5min")


WILD = "1.0::DOUBLE / 14"


@query("rsi", f"WITH RECURSIVE {HOURLY}, p AS (SELECT *, close - {lag('close')} AS st FROM b), r(symbol, ts, bar, u, v) AS (SELECT symbol, ts, bar, greatest(st, 0), greatest(-st, 0) FROM p WHERE bar = 2 UNION ALL SELECT p.symbol, p.ts, p.bar, u + {WILD} * (greatest(st, 0) - u), v + {WILD} * (greatest(-st, 0) - v) FROM r JOIN p ON p.symbol = r.symbol AND p.bar = r.bar + 1) SELECT b.symbol, b.ts, {r6('CASE WHEN b.bar >= 15 THEN 100 - 100 / (1 + u / nullif(v, 0)) END')} AS rsi_14 FROM b LEFT JOIN r ON r.symbol = b.symbol AND r.bar = b.bar")
def rsi(s, d):
    return shown(recursive.with_series(hourly(s, d), recursive.base_series, DEFAULT), "rsi_14")


@query("atr", f"WITH RECURSIVE {HOURLY}, p AS (SELECT *, {TR} AS tr FROM b), r(symbol, ts, bar, a) AS (SELECT symbol, ts, bar, tr FROM p WHERE bar = 1 UNION ALL SELECT p.symbol, p.ts, p.bar, a + {WILD} * (tr - a) FROM r JOIN p ON p.symbol = r.symbol AND p.bar = r.bar + 1) {select({'atr_14': 'CASE WHEN bar >= 14 THEN a END'}, 'r')}")
def atr(s, d):
    return shown(recursive.with_series(hourly(s, d), recursive.base_series, DEFAULT), "atr_14")


@query("adx_di", f"""WITH RECURSIVE {HOURLY}, p AS (SELECT *, {TR} AS tr, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM b),
 q AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pd, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS md FROM p),
 r(symbol, ts, bar, a, x, y) AS (SELECT symbol, ts, bar, tr, pd, md FROM q WHERE bar = 1 UNION ALL SELECT q.symbol, q.ts, q.bar, a + {WILD} * (tr - a), x + {WILD} * (pd - x), y + {WILD} * (md - y) FROM r JOIN q ON q.symbol = r.symbol AND q.bar = r.bar + 1)
{select({'di_plus': 'CASE WHEN bar >= 14 THEN 100 * x / nullif(a, 0) END', 'di_minus': 'CASE WHEN bar >= 14 THEN 100 * y / nullif(a, 0) END'}, 'r')}""")
def adx_di(s, d):
    return shown(recursive.with_series(hourly(s, d), recursive.base_series, DEFAULT), "di_plus", "di_minus")


@query("heikin_ashi", f"WITH RECURSIVE {HOURLY}, " + chain("b.symbol, b.ts, b.bar, (r.o + r.c) / 2, (b.open + b.high + b.low + b.close) / 4, b.high, b.low", "symbol, ts, bar, (open + close) / 2, (open + high + low + close) / 4, high, low", "symbol, ts, bar, o, c, hi, lo") + f" {select({'ha_open': 'o', 'ha_close': 'c', 'ha_high': 'greatest(hi, o, c)', 'ha_low': 'least(lo, o, c)'}, 'r')}")
def heikin_ashi(s, d):
    return shown(candle_features.heikin_ashi(hourly(s, d)), "ha_open", "ha_close", "ha_high", "ha_low")


@query("merge_daily_into_hourly", f"""WITH {HOURLY}, {DAY_OF_HOURS}, p AS (SELECT symbol, day, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS day_close FROM d) SELECT b.symbol, b.ts, {r6('p.day_close')} AS day_close FROM b LEFT JOIN p ON p.symbol = b.symbol AND p.day = date_trunc('day', b.ts)""")
def merge_daily_into_hourly(s, d):
    bars = hourly(s, d)
    return shown(ops.previous_higher(bars, ops.resampled(bars).withColumnRenamed("close", "day_close"), ["day_close"], "day"), "day_close")
