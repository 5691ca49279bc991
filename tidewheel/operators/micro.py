"""Trade tape, funding, order book and cross-asset features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.exprs import KEY, R, TIME, U, bars_since, crosses_above, crosses_below, diff, full, lag, percent, percent_rank, ratio, sma, total

c = F.col


def trade_delta(trades: DataFrame, minutes: int = 5) -> DataFrame:
    """Bought, sold and net size per coin and window, taker share and running delta, from (coin, ts, side B/A, price, size)."""
    w = F.window("ts", f"{minutes} minutes")
    size = lambda s: F.coalesce(F.sum(F.when(c("side") == s, c("size"))), F.lit(0.0))
    out = trades.groupBy(c("coin").alias(KEY), w.alias("w")).agg(size("B").alias("buy_volume"), size("A").alias("sell_volume"), F.count("*").alias("trades"))
    out = out.select(KEY, c("w.start").alias(TIME), "buy_volume", "sell_volume", "trades")
    out = out.withColumns({"delta": c("buy_volume") - c("sell_volume"), "taker_buy_ratio": ratio("buy_volume", c("buy_volume") + c("sell_volume"))})
    return out.withColumn("cvd", F.sum("delta").over(U()))


def funding(hours: DataFrame) -> DataFrame:
    """Trend, change, 8-hour sum, rank and age of the sign of hourly ``funding_rate`` (with ``bar``)."""
    hours = hours.withColumn("_turn", crosses_above("funding_rate", 0) + crosses_below("funding_rate", 0))
    return hours.withColumns({
        "funding_rate_trend": c("funding_rate") - sma("funding_rate", 8), "funding_rate_1h_change": diff("funding_rate"), "funding_rate_8h_sum": total("funding_rate", 8),
        "funding_rate_extreme": percent_rank("funding_rate", 100), "funding_rate_flip_bars": bars_since(c("_turn") > 0),
    }).drop("_turn")


def open_interest(hours: DataFrame) -> DataFrame:
    """Change of ``open_interest`` and its divergence from funding; turnover of 24 hours of ``volume``."""
    rise = percent(diff("open_interest"), lag("open_interest"))
    hours = hours.withColumns({"open_interest_change_pct": rise, "oi_rate_of_change": percent(diff("open_interest", 12), lag("open_interest", 12)), "_day": total("volume", 24)})
    return hours.withColumns({"oi_funding_divergence": F.signum("open_interest_change_pct") * -F.signum("funding_rate"), "volume_oi_ratio": ratio("_day", "open_interest")}).drop("_day")


def book(levels: DataFrame, near: float = 0.005) -> DataFrame:
    """Imbalance, spread and depth of ``bids`` and ``asks``, arrays of struct(price, size) with the best first."""
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["size"])
    bid, ask = c("bids")[0]["price"], c("asks")[0]["price"]
    levels = levels.withColumn("mid", (bid + ask) / 2)
    b, a, b5, a5 = size(c("bids")), size(c("asks")), size(F.slice("bids", 1, 5)), size(F.slice("asks", 1, 5))
    return levels.withColumns({
        "ob_imbalance": ratio(b - a, b + a), "ob_imbalance_top5": ratio(b5 - a5, b5 + a5), "ob_spread_pct": percent(ask - bid, "mid"),
        "ob_bid_depth": size(F.filter("bids", lambda x: x["price"] >= c("mid") * (1 - near))), "ob_ask_depth": size(F.filter("asks", lambda x: x["price"] <= c("mid") * (1 + near))),
    })


def cross_asset(bars: DataFrame, leader: str, n: int = 20, far: int = 100) -> DataFrame:
    """Leader's returns beside each symbol's own: correlation, beta and relative strength. The leader's bars meet on time."""
    own = bars.withColumn("_r", ratio("close", lag("close")) - 1)
    lead = own.where(c(KEY) == leader).select(c(TIME).alias("_t"), c("_r").alias("_lr"), ((ratio("close", lag("close", 5)) - 1) * 100).alias("leader_return_5bar"), (ratio("close", lag("close", n)) - 1).alias("_l20"))
    rows = own.withColumn("_o20", ratio("close", lag("close", n)) - 1).join(lead, c(TIME) == c("_t"))
    both = c("_r").isNotNull() & c("_lr").isNotNull()
    rows = rows.withColumns({"_a": F.when(both, c("_r")), "_b": F.when(both, c("_lr"))})
    return rows.withColumns({
        f"correlation_{n}bar": full("_a", n, F.try_divide(F.covar_pop("_a", "_b").over(R(n)), F.stddev_pop("_a").over(R(n)) * F.stddev_pop("_b").over(R(n)))),
        "beta_to_leader": full("_a", far, F.try_divide(F.covar_pop("_a", "_b").over(R(far)), F.var_pop("_b").over(R(far)))), "relative_strength": ratio("_o20", "_l20"),
    }).drop("_r", "_lr", "_t", "_l20", "_o20", "_a", "_b")
