"""Indicators that learn from their own past: neighbours in Lorentzian distance, and a SuperTrend whose factor is the mean of the best cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.exprs import INDEX, KEY, TIME
from tidewheel.operators.recursive import range_of, wilder

c = F.col


def voted(features: np.ndarray, labels: np.ndarray, first: int, back: int, k: int, every: int, numbers: np.ndarray) -> np.ndarray:
    """For each row from ``first`` on the sum of the labels of its last ``k`` accepted neighbours among the ``back`` rows before it.

    The past is gone through from its oldest row on, leaving out those whose number ``every`` divides.  A row is accepted if it is at least as far as the distance that counts, which
    is then its own; once there are more than ``k`` the oldest goes, and what counts is the distance at three quarters of the list.
    All rows take the same step of their pasts together.
    """
    rows = np.arange(first, len(features))
    counts = np.full(len(rows), -1.0)
    ring = np.zeros((len(rows), k + 1))
    votes = np.zeros((len(rows), k + 1))
    held = np.zeros(len(rows), int)
    mark = round(k * 3 / 4)
    for step in range(back, 0, -1):
        at = rows - step
        live = (at >= 0) & (numbers[np.maximum(at, 0)] % every != 0)
        far = np.log1p(np.abs(features[rows] - features[np.maximum(at, 0)])).sum(1)
        take = live & (far >= counts)  # a missing feature is no distance at all
        i = np.flatnonzero(take)
        if not len(i):
            continue
        counts[i] = far[i]
        ring[i, held[i]], votes[i, held[i]] = far[i], labels[at[i]]
        held[i] += 1
        full = i[held[i] > k]
        if len(full):
            counts[full] = ring[full, mark]
            ring[full, :-1], votes[full, :-1] = ring[full, 1:], votes[full, 1:]
            ring[full, -1] = votes[full, -1] = 0
            held[full] = k
    return votes.sum(1)


def neighbours(bars: DataFrame, features: list[str], back: int = 2000, k: int = 8, every: int = 4, ahead: int = 4, chunk: int = 4096) -> DataFrame:
    """``bars`` with lorentzian_vote and lorentzian_signal: by what followed the most similar bars of the last ``back``, -1, 0 or 1 and then held.

    A bar's label is where the close went in the ``ahead`` bars up to it, as it stands with the bar.  Chunks of a symbol's bars are tasks of their own; each takes the ``back`` bars before
    it along, so a task's size is bounded and symbols are cut anywhere.  Bars with a missing feature get no vote and are nobody's neighbours.
    """
    size = max(chunk, back + ahead)
    place = F.floor((c(INDEX) - 1) / size)
    rows = bars.withColumn("_own", place).withColumn("_chunk", F.explode(F.array(place, place + 1)))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(INDEX, kind="stable").reset_index(drop=True)
        own = (b["_own"] == b["_chunk"]).to_numpy()
        out = b[own].copy()
        if not len(out):
            return out.assign(lorentzian_vote=pd.Series(dtype=float))
        close = b["close"].to_numpy(float)
        label = np.zeros(len(b))
        label[ahead:] = np.sign(close[ahead:] - close[:-ahead])
        found = voted(b[features].to_numpy(float), np.nan_to_num(label), int(np.argmax(own)), back, k, every, b[INDEX].to_numpy())
        found[b.loc[own, features].isna().any(axis=1).to_numpy()] = np.nan
        return out.assign(lorentzian_vote=found)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["lorentzian_vote double"])
    made = rows.groupBy(KEY, "_chunk").applyInPandas(run, schema).drop("_own", "_chunk")
    made = made.withColumn("lorentzian_vote", F.when(~F.isnan("lorentzian_vote"), c("lorentzian_vote")))
    so_far = Window.partitionBy(KEY).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(c("lorentzian_vote") != 0, F.signum("lorentzian_vote"))
    return made.withColumn("lorentzian_signal", F.coalesce(F.last(sign, ignorenulls=True).over(so_far), F.lit(0.0)))


def banded(high: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray, factor: np.ndarray, memory: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, trend, performance) of a SuperTrend whose factor may change from bar to bar.

    The performance is an exponential mean of the moves that the line had on its right side.  Bars without a range have none of the three.
    """
    n = len(close)
    line, trend, perf = np.full(n, np.nan), np.zeros(n), np.full(n, np.nan)
    upper = lower = last = np.nan
    way, gain = 0.0, 0.0
    for i in range(n):
        up, down = (high[i] + low[i]) / 2 + atr[i] * factor[i], (high[i] + low[i]) / 2 - atr[i] * factor[i]
        if np.isnan(up):
            continue
        way = 1.0 if close[i] > upper else 0.0 if close[i] < lower else way
        before = close[i - 1] if i else np.nan
        upper, lower = (min(up, upper) if before < upper else up), (max(down, lower) if before > lower else down)
        side = 0.0 if np.isnan(last) else float(np.sign(before - last))
        gain += 2 / (memory + 1) * ((0.0 if np.isnan(before) else close[i] - before) * side - gain)
        last = lower if way == 1 else upper
        line[i], trend[i], perf[i] = last, way, gain
    return line, trend, perf


def clustered(values: np.ndarray, most: int = 1000) -> np.ndarray:
    """The cluster 0, 1 or 2 of each value of each row: means in one dimension from the quartiles on until they stay."""
    centres = np.percentile(values, [25, 50, 75], axis=1).T
    own = np.zeros(values.shape, int)
    for _ in range(most):
        own = np.abs(values[:, :, None] - centres[:, None, :]).argmin(2)
        sums = np.stack([np.where(own == k, values, 0).sum(1) for k in range(3)], 1)
        sizes = np.stack([(own == k).sum(1) for k in range(3)], 1)
        new = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)  # an empty cluster keeps its centre
        if np.array_equal(new, centres):
            break
        centres = new
    return own


def factor_grid(bars: DataFrame, factors: list[float], n: int = 10, memory: float = 10) -> DataFrame:
    """(symbol, ts, bar, factor, line, trend, perf): a SuperTrend for each factor, each pair of symbol and factor a group of its own."""
    rows = bars.select(KEY, TIME, INDEX, "high", "low", "close").withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(INDEX, kind="stable").reset_index(drop=True)
        line, trend, perf = banded(*[b[x].to_numpy(float) for x in ("high", "low", "close")], wilder(range_of(b), n).to_numpy(), b["factor"].to_numpy(), memory)
        return b[[KEY, TIME, INDEX, "factor"]].assign(line=line, trend=trend, perf=perf)

    made = rows.groupBy(KEY, "factor").applyInPandas(run, f"{KEY} string, {TIME} timestamp_ntz, {INDEX} int, factor double, line double, trend double, perf double")
    return made.withColumns({x: F.when(~F.isnan(x), c(x)) for x in ("line", "perf")})


def clustered_trend(bars: DataFrame, factors: list[float] | None = None, n: int = 10, memory: float = 10, cluster: int = 2) -> DataFrame:
    """``bars`` with cluster_factor, cluster_line and cluster_trend: a SuperTrend by the mean factor of the ``cluster`` (2 the best) of the grid's performances at each bar."""
    factors = factors or [1 + 0.5 * k for k in range(9)]
    grid = factor_grid(bars, factors, n, memory).where("perf is not null").groupBy(c(KEY).alias("_s"), c(INDEX).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("factor", "perf"))).alias("_grid"))
    rows = bars.join(grid.select("_s", "_b", F.col("_grid.factor").alias("_f"), F.col("_grid.perf").alias("_p")), (c(KEY) == c("_s")) & (c(INDEX) == c("_b")), "left").drop("_s", "_b")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(INDEX, kind="stable").reset_index(drop=True)
        factor = np.full(len(b), np.nan)
        there = b["_p"].notna().to_numpy()
        if there.any():
            own = clustered(np.array(b.loc[there, "_p"].tolist(), float)) == cluster
            f = np.array(b.loc[there, "_f"].tolist(), float)
            factor[there] = np.where(own.any(1), np.where(own, f, 0).sum(1) / np.maximum(own.sum(1), 1), np.nan)
        factor = pd.Series(factor).ffill().to_numpy()  # an empty cluster leaves the factor as it was
        line, trend, _ = banded(*[b[x].to_numpy(float) for x in ("high", "low", "close")], wilder(range_of(b), n).to_numpy(), factor, memory)
        return b.drop(columns=["_f", "_p"]).assign(cluster_factor=factor, cluster_line=line, cluster_trend=trend)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema] + [f"{x} double" for x in ("cluster_factor", "cluster_line", "cluster_trend")])
    made = rows.groupBy(KEY).applyInPandas(run, schema)
    return made.withColumns({x: F.when(~F.isnan(x), c(x)) for x in ("cluster_factor", "cluster_line")})
