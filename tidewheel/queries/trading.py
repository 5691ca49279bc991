"""Structure, events, labels, evaluation, trading, microstructure and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.features import events, momentum, structure
from tidewheel.functions import exprs as x
from tidewheel.operators import backtest, evaluate, folds, labels, micro, recursive
from tidewheel.operators.bars import latest_wins
from tidewheel.plans.config import DEFAULT
from tidewheel.plans.matrix import matrix
from tidewheel.queries.base import DAILY, HOURLY, LAG, SOFAR, c, daily, full, hourly, lag, over, query, r6, select, shown, table
from tidewheel.streaming import live

G = DEFAULT


def fresh(s, name: str) -> str:
    """A folder of this call alone, which all executors share."""
    return tempfile.mkdtemp(prefix=f"spark-{name}-") if s.sparkContext.master.startswith("local[") else f"{s.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pivot(v: str, top: bool) -> str:
    """A fractal of five bars, known two bars later."""
    f = "max" if top else "min"
    return f"CASE WHEN count({v}) {over(5)} = 5 AND {lag(v, 2)} = {f}({v}) {over(5)} THEN {lag(v, 2)} END"


@query("fractal_pivots", f"WITH {HOURLY} {select({'pivot_high': pivot('high', True), 'pivot_low': pivot('low', False)}, 'b')}")
def fractal_pivots(s, d):
    return shown(hourly(s, d).withColumns({"pivot_high": x.pivot_high("high"), "pivot_low": x.pivot_low("low")}), "pivot_high", "pivot_low")


STEPS = f"""p AS (SELECT *, {pivot('high', True)} AS h, {pivot('low', False)} AS l FROM b),
 hs AS (SELECT symbol, bar, h - lag(h) OVER (PARTITION BY symbol ORDER BY bar) AS d FROM p WHERE h IS NOT NULL), ls AS (SELECT symbol, bar, l - lag(l) OVER (PARTITION BY symbol ORDER BY bar) AS d FROM p WHERE l IS NOT NULL),
 hc AS (SELECT *, sum(coalesce((d > 0)::INT, 0)) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS k FROM hs), lc AS (SELECT *, sum(coalesce((d < 0)::INT, 0)) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS k FROM ls),
 j AS (SELECT p.*, hc.d AS hd, lc.d AS ld, hc.k AS hk, lc.k AS lk FROM p LEFT JOIN hc ON hc.symbol = p.symbol AND hc.bar = p.bar LEFT JOIN lc ON lc.symbol = p.symbol AND lc.bar = p.bar),
 f AS (SELECT *, last_value(h IGNORE NULLS) {SOFAR} AS lh, last_value(l IGNORE NULLS) {SOFAR} AS ll, last_value(hd IGNORE NULLS) {SOFAR} AS th, last_value(ld IGNORE NULLS) {SOFAR} AS tl, last_value(hk IGNORE NULLS) {SOFAR} AS kh, last_value(lk IGNORE NULLS) {SOFAR} AS kl FROM j),
 y AS (SELECT *, CASE WHEN th > 0 AND tl > 0 THEN 1 WHEN th < 0 AND tl < 0 THEN -1 ELSE 0 END AS st FROM f), z AS (SELECT *, st <> 0 AND st IS DISTINCT FROM {lag('st')} AS ch FROM y)"""
SWING = {
    "swing_high_dist_pct": "(close - lh) / nullif(close, 0) * 100", "swing_low_dist_pct": "(close - ll) / nullif(close, 0) * 100", "structure_type": "st", "bars_since_structure_break": f"bar - max(CASE WHEN ch THEN bar END) {SOFAR}",
    "swing_range_pct": "(lh - ll) / nullif(close, 0) * 100", "higher_highs_count_20": "coalesce(kh, 0)", "lower_lows_count_20": "coalesce(kl, 0)", "retrace_depth": "(lh - close) / nullif(lh - ll, 0)",
    "range_position": f"(close - {full('min', 'low', 20)}) / nullif({full('max', 'high', 20)} - {full('min', 'low', 20)}, 0)",
}


@query("structure_type", f"WITH {HOURLY}, {STEPS} {select(SWING, 'z')}")
def structure_type(s, d):
    return shown(structure.swings(hourly(s, d), G).withColumn("bars_since_structure_break", c("bars_since_structure_break").cast("double")), *SWING)


@query("swing_ratio")
def swing_ratio(s, d):
    """Running swing over the one before it; held against a loop in the tests."""
    return shown(structure.swings(hourly(s, d), G), "swing_ratio")


DIV = f"""f AS (SELECT *, (close - {full('min', 'low', 14)}) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0) * 100 AS f FROM b), k AS (SELECT *, {full('avg', 'f', 3)} AS k FROM f),
 p AS (SELECT *, {pivot('close', True)} AS h, {pivot('close', False)} AS l, {pivot('k', True)} AS oh, {pivot('k', False)} AS ol FROM k),
 a AS (SELECT symbol, bar, h, oh, lag(bar) OVER w AS pb, lag(h) OVER w AS ph, lag(oh) OVER w AS po FROM p WHERE h IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
 z AS (SELECT symbol, bar, l, ol, lag(bar) OVER w AS pb, lag(l) OVER w AS pl, lag(ol) OVER w AS po FROM p WHERE l IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
 q AS (SELECT p.symbol, p.ts, a.bar - a.pb <= 14 AND a.h > a.ph AND a.oh < a.po AS bear, a.bar - a.pb <= 14 AND a.h < a.ph AND a.oh > a.po AS hbear, z.bar - z.pb <= 14 AND z.l < z.pl AND z.ol > z.po AS bull, z.bar - z.pb <= 14 AND z.l > z.pl AND z.ol < z.po AS hbull
   FROM p LEFT JOIN a ON a.symbol = p.symbol AND a.bar = p.bar LEFT JOIN z ON z.symbol = p.symbol AND z.bar = p.bar)"""


@query("divergence", f"WITH {HOURLY}, {DIV} {select({'div': 'CASE WHEN bull THEN 1 WHEN bear THEN -1 ELSE 0 END', 'div_hidden': 'CASE WHEN hbull THEN 1 WHEN hbear THEN -1 ELSE 0 END'}, 'q')}")
def divergence(s, d):
    return shown(structure.divergence(momentum.stochastic(hourly(s, d), G), "stoch_k", "div", G), "div", "div_hidden")


STOCH = f"""f AS (SELECT *, (close - {full('min', 'low', 14)}) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0) * 100 AS f FROM b), k AS (SELECT *, {full('avg', 'f', 3)} AS k FROM f), kd AS (SELECT *, {full('avg', 'k', 3)} AS d FROM k),
 e AS (SELECT *, coalesce({lag('k')} <= {lag('d')} AND k > d AND k < 20, false)::INT AS green, coalesce({lag('k')} >= {lag('d')} AND k < d AND k > 80, false)::INT AS red, CASE WHEN k > 80 THEN 1 WHEN k < 20 THEN 2 ELSE 0 END AS kind FROM kd),
 i AS (SELECT *, sum((kind IS DISTINCT FROM pk)::INT) {SOFAR} AS part FROM (SELECT *, {lag('kind')} AS pk FROM e)),
 u AS (SELECT *, row_number() OVER (PARTITION BY symbol, part ORDER BY ts) AS run, CASE kind WHEN 1 THEN max(k) OVER (PARTITION BY symbol, part ORDER BY ts) - 80 WHEN 2 THEN 20 - min(k) OVER (PARTITION BY symbol, part ORDER BY ts) END AS depth FROM i)"""


@query("stoch_events", f"""WITH {HOURLY}, {STOCH} {select({'stoch_bars_since_green': f'bar - max(CASE WHEN green = 1 THEN bar END) {SOFAR}', 'stoch_bars_since_red': f'bar - max(CASE WHEN red = 1 THEN bar END) {SOFAR}', 'stoch_green_count_50': full('sum', 'green', 50), 'stoch_red_count_50': full('sum', 'red', 50), 'stoch_last_extreme_depth': f'last_value(depth IGNORE NULLS) {SOFAR}', 'stoch_bars_in_ob': f'last_value(CASE WHEN kind = 1 THEN run END IGNORE NULLS) {SOFAR}', 'stoch_bars_in_os': f'last_value(CASE WHEN kind = 2 THEN run END IGNORE NULLS) {SOFAR}'}, 'u')}""")
def stoch_events(s, d):
    names = ["stoch_bars_since_green", "stoch_bars_since_red", "stoch_green_count_50", "stoch_red_count_50", "stoch_last_extreme_depth", "stoch_bars_in_ob", "stoch_bars_in_os"]
    df = events.stochastic(momentum.stochastic(hourly(s, d), G), G)
    return shown(df.withColumns({n: c(n).cast("double") for n in names}), *names)


@query("price_events", f"WITH {HOURLY} {select({'bars_since_new_high_20': f'bar - max(CASE WHEN nh THEN bar END) {SOFAR}', 'bars_since_new_low_20': f'bar - max(CASE WHEN nl THEN bar END) {SOFAR}', 'bars_since_volume_spike': f'bar - max(CASE WHEN sp THEN bar END) {SOFAR}'}, f'(SELECT *, high = {full("max", "high", 20)} AS nh, low = {full("min", "low", 20)} AS nl, volume > 3 * {full("avg", "volume", 20)} AS sp FROM b)')}")
def price_events(s, d):
    names = ["bars_since_new_high_20", "bars_since_new_low_20", "bars_since_volume_spike"]
    df = events.price(hourly(s, d).withColumn("dist_to_nearest_pivot_pct", F.lit(1.0)), G)
    return shown(df.withColumns({n: c(n).cast("double") for n in names}), *names)


#: A stand-in for ATR that SQL can state simply: the mean range of 14 bars.
RANGE14 = full("avg", "high - low", 14)
BARRIER = f"""a AS (SELECT *, {RANGE14} AS atr, count(*) OVER (PARTITION BY symbol) AS n FROM b), u AS (SELECT *, close + 4 * atr AS up, close - 4 * atr AS dn FROM a),
 h AS (SELECT u.symbol, u.bar, min(CASE WHEN o.high >= u.up THEN o.bar - u.bar END) AS iu, min(CASE WHEN o.low <= u.dn THEN o.bar - u.bar END) AS il, arg_max(o.close, o.bar) AS fin FROM u JOIN b o ON o.symbol = u.symbol AND o.bar BETWEEN u.bar + 1 AND u.bar + 48 GROUP BY 1, 2),
 q AS (SELECT u.*, iu, il, fin, u.bar + 48 <= n AS whole, coalesce(atr > 0, false) AS ok, (fin - close) / close * 100 AS mv FROM u LEFT JOIN h ON h.symbol = u.symbol AND h.bar = u.bar),
 l AS (SELECT *, CASE WHEN NOT whole THEN -1 WHEN NOT ok THEN 2 WHEN il IS NOT NULL AND (iu IS NULL OR il <= iu) THEN 1 WHEN iu IS NOT NULL THEN 0 WHEN mv > 0.5 THEN 0 WHEN mv < -0.5 THEN 1 ELSE 2 END AS label,
   CASE WHEN whole AND ok THEN coalesce(least(iu, il), 48) ELSE 48 END AS held, CASE WHEN whole AND ok THEN CASE WHEN il IS NOT NULL AND (iu IS NULL OR il <= iu) THEN dn WHEN iu IS NOT NULL THEN up ELSE fin END END AS px FROM q)"""


def with_range(df: DataFrame) -> DataFrame:
    df = df.withColumn("_hl", c("high") - c("low"))
    return df.withColumn("atr_14", x.sma("_hl", 14)).drop("_hl")


@query("triple_barrier", f"WITH {HOURLY}, {BARRIER} SELECT symbol, ts, label::BIGINT AS label, held::BIGINT AS holding_bars, {r6('px')} AS exit_price, {r6('(px - close) / close * 100')} AS pnl_pct FROM l")
def triple_barrier(s, d):
    return shown(labels.triple_barrier(with_range(hourly(s, d)), G), "label", "holding_bars", "exit_price", "pnl_pct")


@query("label_distribution", f"WITH {HOURLY}, {BARRIER} SELECT symbol, label::BIGINT AS label, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY symbol)')} AS share FROM l GROUP BY symbol, label")
def label_distribution(s, d):
    return labels.distribution(labels.triple_barrier(with_range(hourly(s, d)), G))


@query("relabel", f"WITH {HOURLY}, {BARRIER} SELECT symbol, ts, label::BIGINT AS label FROM l WHERE label <> -1")
def relabel(s, d):
    return shown(labels.relabelled(labels.triple_barrier(with_range(hourly(s, d)), G), G), "label")


@query("class_weights", f"WITH {HOURLY}, {BARRIER}, t AS (SELECT symbol, ts, label FROM l WHERE label >= 0) SELECT symbol, ts, {r6('count(*) OVER () / (3.0 * count(*) OVER (PARTITION BY label))')} AS weight FROM t")
def class_weights(s, d):
    return shown(labels.balanced_weights(labels.triple_barrier(with_range(hourly(s, d)), G).where("label >= 0")), "weight")


TRAIL = f"""a AS (SELECT *, {RANGE14} AS atr, count(*) OVER (PARTITION BY symbol) AS n FROM b),
 o AS (SELECT a.symbol, a.bar, a.close AS c0, 2 * a.atr AS gap, f.bar AS j, f.high, f.low, f.close, greatest(a.close, max(f.close) OVER w) AS top, least(a.close, min(f.close) OVER w) AS bottom FROM a JOIN b f ON f.symbol = a.symbol AND f.bar BETWEEN a.bar + 1 AND a.bar + 96
   WHERE a.bar + 96 <= a.n AND a.atr > 0 WINDOW w AS (PARTITION BY a.symbol, a.bar ORDER BY f.bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 k AS (SELECT symbol, bar, any_value(c0) AS c0, arg_min(top - gap, j) FILTER (low < top - gap) AS below, arg_min(bottom + gap, j) FILTER (high > bottom + gap) AS above, arg_max(close, j) AS fin FROM o GROUP BY symbol, bar),
 q AS (SELECT b.symbol, b.ts, (coalesce(below, fin) - c0) / c0 * 100 AS l, -(coalesce(above, fin) - c0) / c0 * 100 AS s FROM b LEFT JOIN k ON k.symbol = b.symbol AND k.bar = b.bar)"""


@query("trailing_label", f"WITH {HOURLY}, {TRAIL} SELECT symbol, ts, {r6('l')} AS long_pnl_pct, {r6('s')} AS short_pnl_pct, (CASE WHEN l IS NULL THEN -1 WHEN greatest(l, s) <= 0 THEN 2 WHEN l >= s THEN 0 ELSE 1 END)::BIGINT AS trail_label FROM q")
def trailing_label(s, d):
    """The side whose trailing stop kept more."""
    return shown(labels.trailing_stop(with_range(hourly(s, d))), "long_pnl_pct", "short_pnl_pct", "trail_label")


@query("walk_forward_folds", f"""WITH {DAILY}, g AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi, median(gap)::BIGINT AS gap FROM (SELECT *, epoch(ts) - epoch({lag('ts')}) AS gap FROM b) GROUP BY symbol),
 k AS (SELECT symbol, hi, fold, lo + to_months((fold * 6)::INTEGER) AS train_start, lo + to_months((fold * 6)::INTEGER) + to_months(12) AS train_end, gap FROM g, (SELECT unnest(range(0, 40)) AS fold)),
 v AS (SELECT *, train_end + to_seconds(gap * 5) AS val_start, train_end + to_seconds(gap * 5) + to_months(3) AS val_end FROM k)
SELECT symbol, fold::BIGINT AS fold, train_start::TIMESTAMP AS train_start, train_end::TIMESTAMP AS train_end, val_start::TIMESTAMP AS val_start, val_end::TIMESTAMP AS val_end FROM v WHERE val_end <= hi""")
def walk_forward_folds(s, d):
    return folds.walk_forward(daily(s, d), 12, 3, 6, 5)


@query("purged_split", f"WITH {HOURLY} SELECT symbol, ts, CASE WHEN bar - 1 < floor(n * 0.8) THEN 'train' WHEN bar - 1 >= floor(n * 0.8) + 48 THEN 'val' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM b)")
def purged_split(s, d):
    return shown(folds.ordered_split(hourly(s, d), 0.8, 48), "part")


PROBA = f"""{BARRIER}, w AS (SELECT symbol, ts, label, 1 + abs(close - open) AS a, 1 + (high - close) AS bb, 1 + (close - low) AS cc FROM l WHERE label >= 0),
 pr AS (SELECT symbol, ts, label, a / (a + bb + cc) AS p0, bb / (a + bb + cc) AS p1, cc / (a + bb + cc) AS p2 FROM w),
 pq AS (SELECT *, greatest(p0, p1, p2) AS mp, CASE WHEN p0 = greatest(p0, p1, p2) THEN 0 WHEN p1 = greatest(p0, p1, p2) THEN 1 ELSE 2 END AS pred FROM pr)"""


def probabilities(s, d) -> DataFrame:
    """Labels with stand-in probabilities made from the bar's shape."""
    df = labels.triple_barrier(with_range(hourly(s, d)), G).where("label >= 0")
    df = df.withColumns({"_a": 1 + F.abs(c("close") - c("open")), "_b": 1 + (c("high") - c("close")), "_c": 1 + (c("close") - c("low"))})
    whole = c("_a") + c("_b") + c("_c")
    return df.withColumns({"p0": c("_a") / whole, "p1": c("_b") / whole, "p2": c("_c") / whole}).select("symbol", "ts", "label", "p0", "p1", "p2")


@query("log_loss", f"WITH {HOURLY}, {PROBA} SELECT symbol, {r6('avg(-ln(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END))')} AS log_loss, count(*) AS n FROM pr GROUP BY symbol")
def log_loss(s, d):
    return evaluate.log_loss(probabilities(s, d), ["symbol"])


@query("brier", f"WITH {HOURLY}, {PROBA} SELECT 0::BIGINT AS class, {r6('avg(pow(p0 - (label = 0)::INT, 2))')} AS brier FROM pr UNION ALL SELECT 1, {r6('avg(pow(p1 - (label = 1)::INT, 2))')} FROM pr UNION ALL SELECT 2, {r6('avg(pow(p2 - (label = 2)::INT, 2))')} FROM pr")
def brier(s, d):
    return evaluate.brier(probabilities(s, d))


@query("confusion", f"WITH {HOURLY}, {PROBA} SELECT l::BIGINT AS label, p::BIGINT AS pred, count(pq.label) AS n FROM (SELECT unnest([0, 1, 2]) AS l) CROSS JOIN (SELECT unnest([0, 1, 2]) AS p) LEFT JOIN pq ON pq.label = l AND pq.pred = p GROUP BY l, p")
def confusion(s, d):
    return evaluate.confusion(probabilities(s, d))


@query("per_class", f"""WITH {HOURLY}, {PROBA}, k AS (SELECT unnest([0, 1, 2]) AS k), m AS (SELECT k, (SELECT count(*) FROM pq WHERE pred = k AND label = k) AS hit, (SELECT count(*) FROM pq WHERE pred = k) AS said, (SELECT count(*) FROM pq WHERE label = k) AS sup FROM k)
SELECT k::BIGINT AS class, {r6('coalesce(hit / nullif(said, 0), 0)')} AS precision, {r6('coalesce(hit / nullif(sup, 0), 0)')} AS recall, {r6('coalesce(2 * hit / nullif(said + sup, 0), 0)')} AS f1, sup::BIGINT AS support FROM m""")
def per_class(s, d):
    return evaluate.per_class(probabilities(s, d))


SWEEP = f"""sw AS (SELECT symbol, t AS threshold, count(*) FILTER (mp >= t) AS fire_count, avg((mp >= t)::INT) AS fire_rate, count(*) FILTER (mp >= t AND pred <> 2) AS dir_fire_count, avg((mp >= t AND pred <> 2)::INT) AS dir_fire_rate, avg((pred = label)::INT) FILTER (mp >= t AND pred <> 2) AS dir_hit_rate,
 count(*) FILTER (mp >= t AND pred = 0) AS long_fire_count, avg((label = 0)::INT) FILTER (mp >= t AND pred = 0) AS long_hit_rate, count(*) FILTER (mp >= t AND pred = 1) AS short_fire_count, avg((label = 1)::INT) FILTER (mp >= t AND pred = 1) AS short_hit_rate
 FROM pq, (SELECT unnest([0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75]::DOUBLE[]) AS t) GROUP BY symbol, t)"""


@query("threshold_sweep", f"WITH {HOURLY}, {PROBA}, {SWEEP} SELECT symbol, threshold, fire_count, {r6('fire_rate')} AS fire_rate, dir_fire_count, {r6('dir_fire_rate')} AS dir_fire_rate, {r6('dir_hit_rate')} AS dir_hit_rate, long_fire_count, {r6('long_hit_rate')} AS long_hit_rate, short_fire_count, {r6('short_hit_rate')} AS short_hit_rate FROM sw")
def threshold_sweep(s, d):
    return evaluate.threshold_sweep(probabilities(s, d), ["symbol"])


@query("pooled_hit", f"WITH {HOURLY}, {PROBA}, {SWEEP} SELECT threshold, {r6('avg(fire_rate)')} AS fire_rate, sum(long_fire_count)::BIGINT AS long_n, {r6('sum(long_hit_rate * long_fire_count) / nullif(sum(long_fire_count), 0)')} AS long_hit_rate, sum(short_fire_count)::BIGINT AS short_n, {r6('sum(short_hit_rate * short_fire_count) / nullif(sum(short_fire_count), 0)')} AS short_hit_rate FROM sw GROUP BY threshold")
def pooled_hit(s, d):
    return evaluate.pooled(evaluate.threshold_sweep(probabilities(s, d), ["symbol"]))


@query("auc", f"WITH {HOURLY}, {PROBA}, k AS (SELECT label = 0 AS y, rank() OVER (ORDER BY p0) + (count(*) OVER (PARTITION BY p0) - 1) / 2.0 AS r FROM pr) SELECT {r6('(sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y))')} AS auc, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives FROM k")
def auc(s, d):
    return evaluate.auc(probabilities(s, d), "p0", c("label") == 0)


@query("prior_entropy", f"WITH {HOURLY}, {PROBA} SELECT {r6('sum(-p * ln(p))')} AS prior_entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM pr GROUP BY label)")
def prior_entropy(s, d):
    return evaluate.prior_entropy(probabilities(s, d))


@query("coverage_topn", """WITH i AS (SELECT p_brand AS feature, sum(p_retailprice) AS importance FROM part GROUP BY p_brand), k AS (SELECT feature, row_number() OVER o AS rank, importance / sum(importance) OVER () AS share, sum(importance) OVER o / sum(importance) OVER () AS cum FROM i WINDOW o AS (ORDER BY importance DESC, feature))
SELECT feature, rank::BIGINT AS rank, round(share, 6) AS share, round(cum, 6) AS cum_share FROM k WHERE rank <= greatest(5, least(18, (SELECT coalesce(min(rank) FILTER (cum >= 0.8), max(rank)) FROM k)))""")
def coverage_topn(s, d):
    i = table(s, d, "part").groupBy(c("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    return evaluate.coverage(i, 0.8, 5, 18).select("feature", "rank", "share", "cum_share")


@query("seeded_sample")
def seeded_sample(s, d):
    """A hundred bars of least seeded hash."""
    return shown(evaluate.seeded_sample(hourly(s, d), 100, ["symbol", "ts"]), "close")


@query("label_permutation")
def label_permutation(s, d):
    """Labels dealt anew within a symbol: the counts stay."""
    return shown(evaluate.shuffled_labels(probabilities(s, d)), "label")


def signals(s, d) -> DataFrame:
    """A long on a close above the 20-bar mean after one below, a short the other way round."""
    df = with_range(hourly(s, d)).withColumn("m", x.sma("close", 20))
    df = df.withColumns({"_u": x.crosses_above("close", "m"), "_d": x.crosses_below("close", "m")})
    return df.withColumn("side", F.when(c("_u") == 1, 0).when(c("_d") == 1, 1)).drop("_u", "_d", "m")


EXITS = f"""a AS (SELECT *, {RANGE14} AS atr, {full('avg', 'close', 20)} AS m FROM b), g AS (SELECT *, CASE WHEN {lag('close')} <= {lag('m')} AND close > m THEN 0 WHEN {lag('close')} >= {lag('m')} AND close < m THEN 1 END AS side FROM a),
 t AS (SELECT g.*, scheme, CASE WHEN unit = 'atr' THEN atr ELSE close END * tpm AS tp, CASE WHEN unit = 'atr' THEN atr ELSE close END * slm AS sl FROM g, (VALUES ('atr_2_1', 'atr', 2.0::DOUBLE, 1.0::DOUBLE), ('atr_4_4', 'atr', 4.0, 4.0), ('atr_2_2', 'atr', 2.0, 2.0), ('atr_4_2', 'atr', 4.0, 2.0), ('pct_0p5_0p25', 'pct', 0.005, 0.0025), ('pct_0p6_0p6', 'pct', 0.006, 0.006)) v(scheme, unit, tpm, slm) WHERE side IS NOT NULL AND atr > 0),
 t2 AS (SELECT *, CASE side WHEN 0 THEN close + tp ELSE close - tp END AS tpp, CASE side WHEN 0 THEN close - sl ELSE close + sl END AS slp FROM t),
 h AS (SELECT t2.symbol, t2.bar, t2.scheme, min(CASE WHEN (side = 0 AND o.high >= tpp) OR (side = 1 AND o.low <= tpp) THEN o.bar END) AS ti, min(CASE WHEN (side = 0 AND o.low <= slp) OR (side = 1 AND o.high >= slp) THEN o.bar END) AS si, max(o.bar) AS lb, arg_max(o.close, o.bar) AS fin FROM t2 JOIN b o ON o.symbol = t2.symbol AND o.bar BETWEEN t2.bar + 1 AND t2.bar + 48 GROUP BY 1, 2, 3),
 e AS (SELECT t2.*, coalesce(CASE WHEN si IS NOT NULL AND (ti IS NULL OR si <= ti) THEN si ELSE ti END, lb, t2.bar) AS xb, CASE WHEN si IS NOT NULL AND (ti IS NULL OR si <= ti) THEN 'SL' WHEN ti IS NOT NULL THEN 'TP' ELSE 'TIMEOUT' END AS why, CASE WHEN si IS NOT NULL AND (ti IS NULL OR si <= ti) THEN slp WHEN ti IS NOT NULL THEN tpp ELSE coalesce(fin, close) END AS px
   FROM t2 LEFT JOIN h ON h.symbol = t2.symbol AND h.bar = t2.bar AND h.scheme = t2.scheme),
 x AS (SELECT *, CASE side WHEN 0 THEN 1 ELSE -1 END * (px - close) / close AS gross FROM e)"""
TRADES = f"symbol, scheme, bar::BIGINT AS entry_idx, side::BIGINT AS side, xb::BIGINT AS exit_idx, why AS exit_reason, {r6('px')} AS exit_price, {r6('gross')} AS gross_return, {r6('gross - 0.0011')} AS net_return"


@query("barrier_exits", f"WITH {HOURLY}, {EXITS} SELECT {TRADES} FROM x")
def barrier_exits(s, d):
    return backtest.exits(signals(s, d), tuple(backtest.SCHEMES)).select("symbol", "scheme", "entry_idx", "side", "exit_idx", "exit_reason", "exit_price", "gross_return", "net_return")


GREEDY = f"""{EXITS}, nx AS (SELECT *, (SELECT min(y.bar) FROM x y WHERE y.symbol = x.symbol AND y.scheme = x.scheme AND y.bar > x.xb) AS nb FROM x),
 w AS (SELECT nx.* FROM nx WHERE bar = (SELECT min(bar) FROM x y WHERE y.symbol = nx.symbol AND y.scheme = nx.scheme) UNION ALL SELECT n.* FROM w JOIN nx n ON n.symbol = w.symbol AND n.scheme = w.scheme AND n.bar = w.nb)"""


@query("no_stack_trades", f"WITH RECURSIVE {HOURLY}, {GREEDY} SELECT {TRADES} FROM w")
def no_stack_trades(s, d):
    t = backtest.no_stack(backtest.exits(signals(s, d), tuple(backtest.SCHEMES)))
    return t.select("symbol", "scheme", "entry_idx", "side", "exit_idx", "exit_reason", "exit_price", "gross_return", "net_return")


SIZED = f"""{GREEDY}, q AS (SELECT *, gross - 0.0011 AS net, least(0.02::DOUBLE * close / sl, 0.1::DOUBLE) AS share, date_trunc('day', ts) AS day, row_number() OVER (PARTITION BY symbol, scheme ORDER BY bar) AS k FROM w WHERE scheme IN ('atr_4_2', 'pct_0p5_0p25')),
 acc(symbol, scheme, k, bar, day, began, made, n, taken, value, profit, capital) AS (SELECT symbol, scheme, k, bar, day, 10000::DOUBLE, 10000 * share * net, 1, true, 10000 * share, 10000 * share * net, 10000 + 10000 * share * net FROM q WHERE k = 1
 UNION ALL SELECT symbol, scheme, k, bar, day, b0, m0 + v * net, n0 + t::INT, t, v, v * net, capital + v * net FROM (SELECT *, CASE WHEN t THEN capital * share ELSE 0 END AS v FROM (SELECT *, m0 > -0.002::DOUBLE * b0 AND n0 < 2 AS t FROM (
   SELECT q.symbol, q.scheme, q.k, q.bar, q.day, q.share, q.net, acc.capital, CASE WHEN q.day = acc.day THEN acc.began ELSE acc.capital END AS b0, CASE WHEN q.day = acc.day THEN acc.made ELSE 0 END AS m0, CASE WHEN q.day = acc.day THEN acc.n ELSE 0 END AS n0 FROM acc JOIN q ON q.symbol = acc.symbol AND q.scheme = acc.scheme AND q.k = acc.k + 1))))"""


@query("managed_risk", f"WITH RECURSIVE {HOURLY}, {SIZED} SELECT symbol, scheme, bar::BIGINT AS entry_idx, taken, {r6('value')} AS value, {r6('profit')} AS profit, {r6('capital')} AS capital FROM acc")
def managed_risk(s, d):
    """Accounts that risk 2 % a trade, 10 % at most, two trades a day and 0.2 % a day."""
    t = backtest.no_stack(backtest.exits(signals(s, d), ("atr_4_2", "pct_0p5_0p25")))
    return backtest.managed(t, day_loss=0.002, day_trades=2).select("symbol", "scheme", "entry_idx", "taken", "value", "profit", "capital")


@query("equity_drawdown", f"""WITH RECURSIVE {HOURLY}, {GREEDY}, q AS (SELECT *, product(1 + (gross - 0.0011)) OVER o AS eq FROM w WINDOW o AS (PARTITION BY symbol, scheme ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 k AS (SELECT *, max(eq) OVER (PARTITION BY symbol, scheme ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pk FROM q) SELECT symbol, scheme, bar::BIGINT AS entry_idx, {r6('eq')} AS equity, {r6('eq / pk - 1')} AS drawdown FROM k WHERE scheme LIKE 'pct%'""")
def equity_drawdown(s, d):
    safe = backtest.no_stack(backtest.exits(signals(s, d), ("pct_0p5_0p25", "pct_0p6_0p6")))
    return backtest.equity(safe).select("symbol", "scheme", "entry_idx", "equity", "drawdown")


@query("side_stats", f"""WITH RECURSIVE {HOURLY}, {GREEDY}, q AS (SELECT *, gross - 0.0011 AS net FROM w)
SELECT symbol, scheme, count(*) AS n_trades, count(*) FILTER (net > 0) AS n_wins, {r6('avg((net > 0)::INT)')} AS hit_rate, count(*) FILTER (why = 'TP') AS exit_tp, count(*) FILTER (why = 'SL') AS exit_sl, count(*) FILTER (why = 'TIMEOUT') AS exit_timeout,
 {r6('avg(net) * 100')} AS net_mean_pct, {r6('median(net) * 100')} AS net_median_pct, {r6('avg(net) / (stddev_pop(net) + 1e-12)')} AS sharpe_per_trade, count(*) FILTER (side = 0) AS long_n, {r6('avg((net > 0)::INT) FILTER (side = 0)')} AS long_hit_rate, count(*) FILTER (side = 1) AS short_n FROM q GROUP BY symbol, scheme""")
def side_stats(s, d):
    t = backtest.no_stack(backtest.exits(signals(s, d), tuple(backtest.SCHEMES)))
    return backtest.report(t).select("symbol", "scheme", "n_trades", "n_wins", "hit_rate", "exit_tp", "exit_sl", "exit_timeout", "net_mean_pct", "net_median_pct", "sharpe_per_trade", "long_n", "long_hit_rate", "short_n")


def tape(s, d) -> DataFrame:
    e = table(s, d, "events")
    return e.select((F.concat(F.lit("c"), (c("user_id") % 5).cast("string"))).alias("coin"), "ts", F.when(c("event_type") == "purchase", "B").otherwise("A").alias("side"), c("value").alias("price"), c("value").alias("size"), c("event_id").alias("trade_id"))


@query("trade_delta_5m", f"""WITH t AS (SELECT 'c' || (user_id % 5) AS symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, event_type = 'purchase' AS buy, value AS size FROM events),
 g AS (SELECT symbol, ts, coalesce(sum(size) FILTER (buy), 0) AS bv, coalesce(sum(size) FILTER (NOT buy), 0) AS sv, count(*) AS n FROM t GROUP BY 1, 2)
SELECT symbol, ts, {r6('bv')} AS buy_volume, {r6('sv')} AS sell_volume, n AS trades, {r6('bv - sv')} AS delta, {r6('bv / nullif(bv + sv, 0)')} AS taker_buy_ratio, {r6(f'sum(bv - sv) {SOFAR}')} AS cvd FROM g""")
def trade_delta_5m(s, d):
    return micro.trade_delta(tape(s, d))


FUND = f"""{HOURLY}, f AS (SELECT symbol, ts, bar, close - open AS r FROM b), k AS (SELECT *, CASE WHEN ({lag('r')} <= 0 AND r > 0) OR ({lag('r')} >= 0 AND r < 0) THEN bar END AS t FROM f)"""


@query("funding_deep", f"WITH {FUND} {select({'funding_rate_trend': f'r - {full("avg", "r", 8)}', 'funding_rate_1h_change': f'r - {lag("r")}', 'funding_rate_8h_sum': full('sum', 'r', 8), 'funding_rate_flip_bars': f'bar - max(t) {SOFAR}'}, 'k')}")
def funding_deep(s, d):
    df = micro.funding(hourly(s, d).withColumn("funding_rate", c("close") - c("open")))
    return shown(df.withColumn("funding_rate_flip_bars", c("funding_rate_flip_bars").cast("double")), "funding_rate_trend", "funding_rate_1h_change", "funding_rate_8h_sum", "funding_rate_flip_bars")


@query("book_imbalance", f"""WITH v AS (SELECT vec_id, [abs(v)::DOUBLE FOR v IN embedding] AS e FROM embeddings), q AS (SELECT vec_id, list_sum(e[1:8]) AS b, list_sum(e[9:16]) AS a, list_sum(e[1:5]) AS b5, list_sum(e[9:13]) AS a5 FROM v)
SELECT vec_id, {r6('(b - a) / nullif(b + a, 0)')} AS ob_imbalance, {r6('(b5 - a5) / nullif(b5 + a5, 0)')} AS ob_imbalance_top5 FROM q""")
def book_imbalance(s, d):
    """Books made from vectors: eight sizes a side, prices one tick apart."""
    v = table(s, d, "embeddings").withColumn("e", F.transform("embedding", lambda y: F.abs(y.cast("double"))))
    side = lambda start, way: F.transform(F.slice("e", start, 8), lambda y, i: F.struct((F.lit(100.0) + way * (i + 1) * 0.01).alias("price"), y.alias("size")))
    return micro.book(v.withColumns({"bids": side(1, -1), "asks": side(9, 1)})).select("vec_id", "ob_imbalance", "ob_imbalance_top5")


@query("cross_asset", f"""WITH {HOURLY}, o AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS r, close / nullif({lag('close', 20)}, 0) - 1 AS r20, (close / nullif({lag('close', 5)}, 0) - 1) * 100 AS r5 FROM b),
 j AS (SELECT o.symbol, o.ts, o.r20, l.r5, l.r20 AS l20, CASE WHEN o.r IS NOT NULL AND l.r IS NOT NULL THEN o.r END AS a, CASE WHEN o.r IS NOT NULL AND l.r IS NOT NULL THEN l.r END AS z FROM o JOIN o l ON l.symbol = 'click' AND l.ts = o.ts)
{select({'leader_return_5bar': 'r5', 'correlation_20bar': f'CASE WHEN count(a) {over(20)} = 20 THEN covar_pop(a, z) {over(20)} / nullif(stddev_pop(a) {over(20)} * stddev_pop(z) {over(20)}, 0) END', 'relative_strength': 'r20 / nullif(l20, 0)'}, 'j')}""")
def cross_asset(s, d):
    return shown(micro.cross_asset(hourly(s, d), "click"), "leader_return_5bar", "correlation_20bar", "relative_strength")


@query("feature_matrix")
def feature_matrix(s, d):
    """All 303 features of hourly bars with the day as next timeframe."""
    base = fresh(s, "matrix")
    n = [0]

    def cut(df: DataFrame) -> DataFrame:
        n[0] += 1
        path = f"{base}/matrix-{n[0]}"
        df.write.mode("overwrite").parquet(path)
        return s.read.schema(df.schema).parquet(path)

    return matrix(hourly(s, d).drop("bar"), unit="day", cut=cut)


def replay(s, d, name: str, columns: str) -> DataFrame:
    return s.readStream.schema(table(s, d, name).schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/{name}.parque[t]").selectExpr(*columns.split("; "))


def drained(s, stream: DataFrame, schema) -> DataFrame:
    """Runs a stream over what is there and returns what it appended."""
    base = fresh(s, "stream")
    q = live.appending(stream, f"{base}/out", f"{base}/state", available_now=True)
    q.awaitTermination()
    return s.read.schema(schema).parquet(f"{base}/out")


@query("stream_tumbling_bars", f"""WITH t AS (SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS w, ts, event_id, value FROM events)
SELECT symbol, w AS ts, {r6('first(value ORDER BY ts, event_id)')} AS open, {r6('max(value)')} AS high, {r6('min(value)')} AS low, {r6('last(value ORDER BY ts, event_id)')} AS close, {r6('count(*)::DOUBLE')} AS volume FROM t
GROUP BY symbol, w HAVING w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_tumbling_bars(s, d):
    ticks = replay(s, d, "events", "event_type as symbol; cast(ts as timestamp) as ts; value as price; cast(1 as double) as size; event_id as seq")
    bars = live.tumbling_bars(ticks, "1 hour")
    return drained(s, bars, bars.schema).withColumn("ts", c("ts").cast("timestamp_ntz"))


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(s, d):
    rows = replay(s, d, "events", "user_id; event_type; cast(ts as timestamp) as ts")
    return drained(s, live.once(rows, ["user_id", "event_type"], "400 days").select("user_id", "event_type"), "user_id long, event_type string")


@query("stream_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_upsert(s, d):
    base = fresh(s, "upsert")

    def merge(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/merged/batch={number}")

    live.upserting(replay(s, d, "events", "user_id; event_id"), ["user_id"], ["event_id"], merge, f"{base}/state", available_now=True).awaitTermination()
    return latest_wins(s.read.schema("user_id long, event_id long, batch int").parquet(f"{base}/merged"), ["user_id"], [c("event_id")]).select("user_id", "event_id")
