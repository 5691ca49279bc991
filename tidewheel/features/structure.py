"""Fractal pivots, divergences between price and oscillators, swings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.exprs import INDEX, KEY, U, W, bars_since, filled, flag, highest, holds, lag, lowest, percent, pivot_high, pivot_low, ratio
from tidewheel.plans.config import Config

c = F.col


def BEFORE():
    """All bars before the current one."""
    return W().rowsBetween(Window.unboundedPreceding, -1)


def divergence(df: DataFrame, oscillator: str, name: str, g: Config, reach: int = 14) -> DataFrame:
    """``name`` and ``name``_hidden: +1 bullish, -1 bearish, 0 none.

    A new pivot of the close is held against the pivot before it, if that was
    confirmed at most ``reach`` bars ago; the oscillator counts where it has a pivot on the same bar.
    """
    n = g.fractal
    df = df.withColumns({"_h": pivot_high("close", n), "_l": pivot_low("close", n), "_oh": pivot_high(oscillator, n), "_ol": pivot_low(oscillator, n)})
    last = lambda p: F.last(F.when(c(p).isNotNull(), F.struct(c(INDEX).alias("i"), c(p).alias("p"), c("_o" + p[1]).alias("o"))), ignorenulls=True).over(BEFORE())
    df = df.withColumns({"_ph": last("_h"), "_pl": last("_l")})
    near = lambda p: c(p).isNotNull() & (c(INDEX) - c("_p" + p[1])["i"] <= reach)
    h, l = c("_h"), c("_l")
    bear, hidden_bear = near("_h") & (h > c("_ph")["p"]) & (c("_oh") < c("_ph")["o"]), near("_h") & (h < c("_ph")["p"]) & (c("_oh") > c("_ph")["o"])
    bull, hidden_bull = near("_l") & (l < c("_pl")["p"]) & (c("_ol") > c("_pl")["o"]), near("_l") & (l > c("_pl")["p"]) & (c("_ol") < c("_pl")["o"])
    either = lambda up, down: F.when(holds(up), 1.0).when(holds(down), -1.0).otherwise(0.0)
    return df.withColumns({name: either(bull, bear), f"{name}_hidden": either(hidden_bull, hidden_bear)}).drop("_h", "_l", "_oh", "_ol", "_ph", "_pl")


def divergences(df: DataFrame, g: Config) -> DataFrame:
    names = {"rsi": "rsi_14", "macd": "macd_hist_5min", "wt": "wt1_5min", "stoch": "stoch_k"}
    for k, oscillator in names.items():
        df = divergence(df, oscillator, f"{k}_price_divergence", g)
    count = sum((F.abs(f"{k}_price_divergence") for k in names), F.lit(0.0))
    df = df.withColumns({"divergence_count": count, "hidden_divergence": c("rsi_price_divergence_hidden")})
    return df.withColumn("divergence_freshness", bars_since(c("divergence_count") > 0)).drop(*[f"{k}_price_divergence_hidden" for k in names])


def swings(df: DataFrame, g: Config) -> DataFrame:
    """Distances from the last swing points, trend structure, and the ratio of the last two swings."""
    n = g.fractal
    df = df.withColumns({"_h": pivot_high("high", n), "_l": pivot_low("low", n)})
    df = df.withColumns({"_lh": filled("_h"), "_ll": filled("_l"), "_ph": F.last("_h", ignorenulls=True).over(BEFORE()), "_pl": F.last("_l", ignorenulls=True).over(BEFORE())})
    # Whether the last high was above the one before it, known from the bar that confirmed it on.
    up, down = F.when(c("_h").isNotNull() & c("_ph").isNotNull(), F.signum(c("_h") - c("_ph"))), F.when(c("_l").isNotNull() & c("_pl").isNotNull(), F.signum(c("_l") - c("_pl")))
    df = df.withColumns({"_uh": up, "_ul": down})
    df = df.withColumns({"_th": filled("_uh"), "_tl": filled("_ul")})
    kind = F.when((c("_th") > 0) & (c("_tl") > 0), 1.0).when((c("_th") < 0) & (c("_tl") < 0), -1.0).otherwise(0.0)
    df = df.withColumn("structure_type", kind)
    changed = (c("structure_type") != 0) & (lag("structure_type").isNull() | (c("structure_type") != lag("structure_type")))
    df = df.withColumn("_changed", changed)
    steps = {"_sh": F.when(c("_h").isNotNull() & c("_ph").isNotNull(), flag(c("_h") > c("_ph"))), "_sl": F.when(c("_l").isNotNull() & c("_pl").isNotNull(), flag(c("_l") < c("_pl")))}
    df = df.withColumns(steps)
    df = _last_steps(_last_steps(df, "_sh", "higher_highs_count_20"), "_sl", "lower_lows_count_20")
    hi, lo = highest("high", 20), lowest("low", 20)
    df = df.withColumns({
        "swing_high_dist_pct": percent(c("close") - c("_lh"), "close"), "swing_low_dist_pct": percent(c("close") - c("_ll"), "close"), "bars_since_structure_break": bars_since(c("_changed")),
        "swing_range_pct": percent(c("_lh") - c("_ll"), "close"), "retrace_depth": ratio(c("_lh") - c("close"), c("_lh") - c("_ll")), "range_position": ratio(c("close") - lo, hi - lo),
    })
    return swing_ratio(df)


def _last_steps(df: DataFrame, step: str, name: str, n: int = 19) -> DataFrame:
    """Sum of the last n steps that there were, carried on between them: a difference of running sums."""
    df = df.withColumns({"_k": F.sum(F.when(c(step).isNotNull(), 1).otherwise(0)).over(U()), "_s": F.sum(F.coalesce(step, F.lit(0))).over(U())})
    # The running sum at the step n before: looked up among the steps alone.
    steps = Window.partitionBy(KEY, c(step).isNotNull()).orderBy(INDEX)
    df = df.withColumn("_b", F.when(c(step).isNotNull(), c("_s") - F.coalesce(F.lag("_s", n).over(steps), F.lit(0))))
    return df.withColumn(name, F.coalesce(filled("_b"), F.lit(0)).cast("double")).drop("_k", "_s", "_b")


def swing_ratio(df: DataFrame) -> DataFrame:
    """Length of the running swing over that of the one before it.

    Pivots become one sequence (a high before a low on the same bar); a change
    of kind starts a leg, whose end is the leg's extreme so far.
    """
    points = df.select(KEY, INDEX, F.explode(F.filter(F.array(F.struct(F.lit(0).alias("o"), c("_h").alias("v")), F.struct(F.lit(1).alias("o"), c("_l").alias("v"))), lambda x: x["v"].isNotNull())).alias("x"))
    order = Window.partitionBy(KEY).orderBy(INDEX, "o")
    points = points.select(KEY, INDEX, "x.o", "x.v").withColumn("new", F.coalesce((c("o") != F.lag("o").over(order)).cast("int"), F.lit(1)))
    points = points.withColumn("leg", F.sum("new").over(order))
    within = Window.partitionBy(KEY, "leg").orderBy(INDEX, "o").rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumn("end", F.when(c("o") == 0, F.max("v").over(within)).otherwise(F.min("v").over(within)))
    ends = points.groupBy(KEY, "leg").agg(F.max_by("end", F.struct(INDEX, "o")).alias("final"))
    legs = Window.partitionBy(KEY).orderBy("leg")
    ends = ends.withColumns({"p1": F.lag("final", 1).over(legs), "p2": F.lag("final", 2).over(legs)})
    points = points.join(ends.select(KEY, "leg", "p1", "p2"), [KEY, "leg"])
    points = points.withColumn("r", ratio(F.abs(c("end") - c("p1")), F.abs(c("p1") - c("p2"))))
    last = points.groupBy(KEY, INDEX).agg(F.max_by("r", "o").alias("_r"))
    df = df.join(last, [KEY, INDEX], "left")
    return df.withColumn("swing_ratio", filled("_r")).drop("_r")
