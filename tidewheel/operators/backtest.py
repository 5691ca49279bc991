"""Trades from signals: exits of all signals in parallel, then the ones that don't overlap, then equity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.exprs import INDEX, KEY, TIME
from tidewheel.operators.labels import ahead, barrier_exit
from tidewheel.plans.config import DEFAULT, Config

c = F.col
#: Fixed values: (unit, profit distance, loss distance) in ATRs or shares of the price.
SCHEMES = {
    "atr_2_1": ("atr", 2.0, 1.0), "atr_4_4": ("atr", 4.0, 4.0), "atr_2_2": ("atr", 2.0, 2.0),
    "atr_4_2": ("atr", 4.0, 2.0), "pct_0p5_0p25": ("pct", 0.005, 0.0025), "pct_0p6_0p6": ("pct", 0.006, 0.006),
}


def exits(signals: DataFrame, schemes: tuple[str, ...] = ("atr_4_4",), g: Config = DEFAULT, atr: str = "atr_14") -> DataFrame:
    """One row per signal (``side`` 0 long, 1 short) and scheme with its exit, as if it were the only trade.

    ``signals`` are all bars, with a null side where there is no signal.  Profit
    and loss on one bar count as a loss; at the horizon, or the last bar, the close decides.
    """
    rows = ahead(signals, g.horizon).where(c("side").isNotNull() & (c(atr) > 0))
    table = F.array(*[F.struct(F.lit(s).alias("scheme"), (F.lit(SCHEMES[s][1]) * (c(atr) if SCHEMES[s][0] == "atr" else c("close"))).alias("tp"), (F.lit(SCHEMES[s][2]) * (c(atr) if SCHEMES[s][0] == "atr" else c("close"))).alias("sl")) for s in schemes])
    rows = rows.withColumn("x", F.explode(table)).select("*", "x.*").drop("x")
    way = F.when(c("side") == 0, 1.0).otherwise(-1.0)
    rows = rows.withColumns({"tp_price": c("close") + way * c("tp"), "sl_price": c("close") - way * c("sl"), "_way": way})
    up, down = barrier_exit(c("_path"), F.greatest("tp_price", "sl_price"), F.least("tp_price", "sl_price"))
    rows = rows.withColumns({"_u": up, "_d": down})
    rows = rows.withColumns({"_tp": F.when(c("side") == 0, c("_u")).otherwise(c("_d")), "_sl": F.when(c("side") == 0, c("_d")).otherwise(c("_u"))})
    lost = c("_sl").isNotNull() & (c("_tp").isNull() | (c("_sl") <= c("_tp")))
    reason = F.when(lost, "SL").when(c("_tp").isNotNull(), "TP").otherwise("TIMEOUT")
    rows = rows.withColumns({"exit_reason": reason, "exit_idx": c(INDEX) + F.coalesce(F.when(lost, c("_sl")).otherwise(c("_tp")), F.size("_path"))})
    final = F.coalesce(F.try_element_at("_path", F.lit(-1))["close"], c("close"))
    price = F.when(c("exit_reason") == "SL", c("sl_price")).when(c("exit_reason") == "TP", c("tp_price")).otherwise(final)
    rows = rows.withColumn("exit_price", price)
    rows = rows.withColumn("gross_return", c("_way") * F.try_divide(c("exit_price") - c("close"), c("close")))
    return rows.select(KEY, "scheme", c(INDEX).alias("entry_idx"), c(TIME).alias("entry_ts"), "side", c("close").alias("entry_price"), "exit_idx", "exit_price", "exit_reason", "tp_price", "sl_price", "gross_return", (c("gross_return") - g.cost).alias("net_return"))


def no_stack(trades: DataFrame) -> DataFrame:
    """The trades taken when a new one is only entered after the last has ended: one pass in entry order per symbol and scheme."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("entry_idx", kind="stable")
        kept, free = [], -1
        for i, (a, b) in enumerate(zip(t["entry_idx"].tolist(), t["exit_idx"].tolist(), strict=True)):
            if a > free:
                kept.append(i)
                free = b
        return t.iloc[kept]

    return trades.groupBy(KEY, "scheme").applyInPandas(run, trades.schema)


def equity(trades: DataFrame) -> DataFrame:
    """Trades with equity, its peak and drawdown, in entry order."""
    order = Window.partitionBy(KEY, "scheme").orderBy("entry_idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    out = trades.withColumn("equity", F.product(1 + c("net_return")).over(so_far))
    out = out.withColumn("peak", F.max("equity").over(so_far))
    return out.withColumn("drawdown", c("equity") / c("peak") - 1)


def report(trades: DataFrame) -> DataFrame:
    """One row per symbol and scheme: counts, hit rates, returns, drawdown, Sharpe, profit factor, per side."""
    rows = equity(trades)
    net, won = c("net_return"), c("net_return") > 0
    side = lambda k, x: F.when(c("side") == k, x)
    mean = lambda x: F.avg(x) * 100
    return rows.groupBy(KEY, "scheme").agg(
        F.count("*").alias("n_trades"), F.count_if(won).alias("n_wins"), F.avg(won.cast("double")).alias("hit_rate"),
        *[F.count_if(c("exit_reason") == r).alias(f"exit_{r.lower()}") for r in ("TP", "SL", "TIMEOUT")],
        mean("gross_return").alias("gross_mean_pct"), mean("net_return").alias("net_mean_pct"), (F.median("net_return") * 100).alias("net_median_pct"),
        ((F.product(1 + c("net_return")) - 1) * 100).alias("cum_return_pct"), (F.min("drawdown") * 100).alias("max_drawdown_pct"),
        (F.avg("net_return") / (F.stddev_pop("net_return") + 1e-12)).alias("sharpe_per_trade"),
        F.try_divide(F.sum(F.when(won, net)), -F.sum(F.when(~won, net))).alias("profit_factor"), F.avg(c("exit_idx") - c("entry_idx")).alias("mean_bars"),
        *[x for k, s in enumerate(("long", "short")) for x in (F.count(side(k, net)).alias(f"{s}_n"), F.avg(side(k, won.cast("double"))).alias(f"{s}_hit_rate"), mean(side(k, net)).alias(f"{s}_net_mean_pct"))],
    )


def position_size(balance: Column, risk: float, entry: Column, stop: Column, most: float) -> Column:
    """Units whose loss at the stop is a share of the balance, capped by a share of it in value."""
    return F.least(F.try_divide(balance * risk, F.abs(entry - stop)), F.try_divide(balance * most, entry))


def managed(trades: DataFrame, capital: float = 10_000.0, risk: float = 0.02, most: float = 0.10, day_loss: float = 0.05, day_trades: int = 7) -> DataFrame:
    """``trades`` that don't overlap, with taken, value, profit and capital of an account for each symbol and scheme.

    A position risks ``risk`` of the account's capital at its stop and is worth ``most`` of it at most.  Once a day's trades have lost ``day_loss`` of what
    the day began with, or were ``day_trades``, the day's further ones are left out.  A trade counts for the day of its entry.  The state goes from trade to trade, so
    an account's trades are one group; accounts run in parallel.
    """

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("entry_idx", kind="stable").reset_index(drop=True)
        # What position_size gives, as a share of the balance.
        share = (risk * t["entry_price"] / (t["entry_price"] - t["sl_price"]).abs()).clip(upper=most).fillna(0.0)
        have, today, began, made, n = capital, None, capital, 0.0, 0
        rows = []
        for day, part, net in zip(t["entry_ts"].dt.date, share, t["net_return"], strict=True):
            if day != today:
                today, began, made, n = day, have, 0.0, 0
            taken = made > -day_loss * began and n < day_trades
            value = have * part if taken else 0.0
            have, made, n = have + value * net, made + value * net, n + taken
            rows.append((taken, value, value * net, have))
        return t.join(pd.DataFrame(rows, columns=["taken", "value", "profit", "capital"], index=t.index))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in trades.schema] + ["taken boolean", "value double", "profit double", "capital double"])
    return trades.groupBy(KEY, "scheme").applyInPandas(run, schema)
