"""Labels from the bars ahead: triple barrier and trailing stop. Long is 0, short 1, neutral 2, unlabelled -1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.exprs import KEY, forward
from tidewheel.plans.config import DEFAULT, Config

c = F.col
LONG, SHORT, NEUTRAL, NONE = 0, 1, 2, -1


def first_place(path: Column, test) -> Column:
    """Place from 1 of the first element of an array that passes; null if none does."""
    at = F.array_position(F.transform(path, test), True)
    return F.when(at > 0, at.cast("int"))


def barrier_exit(path: Column, up: Column, down: Column) -> tuple[Column, Column]:
    """Places at which the high first reaches ``up`` and the low ``down``."""
    return first_place(path, lambda x: x["high"] >= up), first_place(path, lambda x: x["low"] <= down)


def ahead(df: DataFrame, horizon: int) -> DataFrame:
    """``df`` with ``_path``, the next bars as an array; one forward frame, no self-join."""
    return df.withColumn("_path", F.collect_list(F.struct("high", "low", "close")).over(forward(horizon)))


def triple_barrier(df: DataFrame, g: Config = DEFAULT, atr: str = "atr_14") -> DataFrame:
    """``df`` with label, holding_bars, exit_price and pnl_pct.

    The first touch of a barrier decides; if one bar touches both, the nearer
    barrier does (the lower one at equal distance).  Without a touch the move
    at the horizon decides, neutral within the symbol's least profit.  Bars
    without a usable ATR stay neutral and unpriced, and the last ``horizon`` bars have no label.
    """
    least = F.coalesce(F.create_map(*[F.lit(x) for kv in g.min_profit_of.items() for x in kv])[c(KEY)], F.lit(g.min_profit)) if g.min_profit_of else F.lit(g.min_profit)
    df = ahead(df, g.horizon).withColumns({"_upper": c("close") + g.tp_atr * c(atr), "_lower": c("close") - g.sl_atr * c(atr)})
    up, down = barrier_exit(c("_path"), c("_upper"), c("_lower"))
    df = df.withColumns({"_up": up, "_down": down, "_whole": F.size("_path") == g.horizon, "_usable": F.coalesce(c(atr) > 0, F.lit(False))})
    both = c("_up") == c("_down")
    low_first = (c("_down") < c("_up")) | c("_up").isNull() | (both if g.sl_atr <= g.tp_atr else F.lit(False))
    hit = c("_up").isNotNull() | c("_down").isNotNull()
    final = F.element_at("_path", -1)["close"]
    move = F.try_divide(final - c("close"), c("close")) * 100
    price = F.when(hit & low_first, c("_lower")).when(hit, c("_upper")).otherwise(final)
    label = F.when(hit & low_first, SHORT).when(hit, LONG).when(move > least, LONG).when(move < -least, SHORT).otherwise(NEUTRAL)
    held = F.when(hit, F.least("_up", "_down")).otherwise(g.horizon)
    df = df.withColumns({
        "label": F.when(~c("_whole"), NONE).when(~c("_usable"), NEUTRAL).otherwise(label), "holding_bars": F.when(c("_whole") & c("_usable"), held).otherwise(g.horizon).cast("int"),
        "exit_price": F.when(c("_whole") & c("_usable"), price),
    })
    return df.withColumn("pnl_pct", F.try_divide(c("exit_price") - c("close"), c("close")) * 100).drop("_path", "_upper", "_lower", "_up", "_down", "_whole", "_usable")


def relabelled(labelled: DataFrame, g: Config, atr: str = "atr_14") -> DataFrame:
    """Stored features with new labels; unlabelled bars go."""
    return triple_barrier(labelled.drop("label", "holding_bars", "exit_price", "pnl_pct"), g, atr).where(c("label") != NONE)


def trailing_stop(df: DataFrame, width: float = 2.0, horizon: int = 96, atr: str = "atr_14") -> DataFrame:
    """``df`` with long_pnl_pct, short_pnl_pct and trail_label: the side whose trailing stop kept more.

    The long stop follows the highest close by ``width`` ATRs and exits on a lower low; the short one mirrors it.
    """
    df = ahead(df, horizon)

    def exit_of(way: int) -> Column:
        start = F.struct(c("close").alias("best"), F.lit(None).cast("double").alias("out"), c("close").alias("last"))

        def step(state: Column, bar: Column) -> Column:
            stop = state["best"] - way * width * c(atr)
            out = F.when(state["out"].isNotNull(), state["out"]).when((bar["low"] < stop) if way > 0 else (bar["high"] > stop), stop)
            best = F.greatest(state["best"], bar["close"]) if way > 0 else F.least(state["best"], bar["close"])
            return F.struct(best.alias("best"), out.alias("out"), bar["close"].alias("last"))

        done = F.aggregate("_path", start, step)
        return way * F.try_divide(F.coalesce(done["out"], done["last"]) - c("close"), c("close")) * 100

    usable = (F.size("_path") == horizon) & (c(atr) > 0)
    df = df.withColumns({"long_pnl_pct": F.when(usable, exit_of(1)), "short_pnl_pct": F.when(usable, exit_of(-1))})
    best = F.when(F.greatest("long_pnl_pct", "short_pnl_pct") <= 0, NEUTRAL).when(c("long_pnl_pct") >= c("short_pnl_pct"), LONG).otherwise(SHORT)
    return df.withColumn("trail_label", F.when(c("long_pnl_pct").isNull(), NONE).otherwise(best)).drop("_path")


def distribution(labelled: DataFrame) -> DataFrame:
    """Count and share of each label per symbol."""
    n = labelled.groupBy(KEY, "label").agg(F.count("*").alias("n"))
    return n.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy(KEY)))


def balanced_weights(labelled: DataFrame, classes: int = 3) -> DataFrame:
    """``labelled`` with weight = rows / (classes * rows of the label); one row per label is joined back."""
    n = labelled.groupBy("label").agg(F.count("*").alias("_n"))
    n = n.withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(0))))
    return labelled.join(n, "label").withColumn("weight", c("_all") / (classes * c("_n"))).drop("_n", "_all")
