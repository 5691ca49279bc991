"""Levels, zones and learning indicators against plain loops."""

import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.features import learned, zones
from tidewheel.operators.crossings import first_below

SCHEMA = "symbol string, ts timestamp_ntz, bar int, open double, high double, low double, close double, volume double"


def walk(seed, n, symbols=("A", "B")):
    rng = random.Random(seed)
    rows = []
    for s in symbols:
        p = 100.0
        for i in range(n):
            o, p = p, max(5.0, p + rng.gauss(0, 2))
            rows.append((s, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), i + 1, o, max(o, p) + rng.random(), min(o, p) - rng.random(), p, float(rng.randint(1, 9))))
    return rows


@pytest.mark.parametrize("chunk", [1, 5, 16, 1000])
def test_first_below_like_a_loop(spark, chunk):
    rng = random.Random(chunk)
    bars = [(s, i, None if rng.random() < 0.1 else rng.gauss(0, 5)) for s in "AB" for i in range(1, 90) if rng.random() < 0.9]
    levels = [(s, k, rng.randint(0, 95), None if rng.random() < 0.05 else rng.gauss(-4, 6)) for s in "ABC" for k in range(40)]
    got = first_below(spark.createDataFrame(bars, "symbol string, bar int, x double"), spark.createDataFrame(levels, "symbol string, id long, bar int, level double"), chunk)
    want = [(s, k, min((b for t, b, x in bars if t == s and b >= at and x is not None and level is not None and x < level), default=None)) for s, k, at, level in levels]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(m is None for _, _, m in want) > 5 < sum(m is not None for _, _, m in want)


def test_no_level_meets_bars_in_pairs(spark):
    bars = spark.range(20_000).select(F.lit("A").alias("symbol"), F.col("id").cast("int").alias("bar"), (100 - F.col("id") / 1000).alias("x"))
    levels = spark.range(0, 20_000, 10).select(F.lit("A").alias("symbol"), "id", F.lit(0).alias("bar"), (100 - F.col("id") / 1000).alias("level"))
    got = first_below(bars, levels, 512)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.id: r.met for r in got.collect()} == {i: i + 1 for i in range(0, 20_000, 10)}


def test_channels_like_a_loop(spark):
    n, back, span, most = 3, 40, 30, 4
    data = walk(1, 160)
    got = {}
    for r in zones.channels(spark.createDataFrame(data, SCHEMA), n, back, 0.2, span, most).collect():
        got.setdefault((r.symbol, r.ts), {})[r["rank"]] = (r.strength, r.top, r.bottom)
    want = {}
    for s in "AB":
        b = [r for r in data if r[0] == s]
        high, low = [r[4] for r in b], [r[5] for r in b]
        pivots = {}
        for i in range(2 * n, len(b)):
            around = range(i - 2 * n, i + 1)
            if high[i - n] == max(high[j] for j in around):
                pivots[i] = high[i - n]
            elif low[i - n] == min(low[j] for j in around):
                pivots[i] = low[i - n]
        for i in pivots:
            if i + 1 < span:
                continue
            width = (max(high[i - span + 1 : i + 1]) - min(low[i - span + 1 : i + 1])) * 0.2
            near = [pivots[j] for j in range(i, max(-1, i - back - 1), -1) if j in pivots]
            rows = range(max(0, i - back), i + 1)
            made = []
            for start in near:
                lo = hi = start
                inside = 0
                for v in near:
                    if v <= hi and hi - v <= width:
                        lo, inside = min(lo, v), inside + 1
                    elif v > hi and v - lo <= width:
                        hi, inside = v, inside + 1
                made.append([20 * inside + sum(lo <= high[j] <= hi or lo <= low[j] <= hi for j in rows), hi, lo])
            found = []
            while made and len(found) < most:
                best = made[[m[0] for m in made].index(max(m[0] for m in made))]
                found.append(tuple(best))
                made = [m for m in made if not (best[2] <= m[1] <= best[1] or best[2] <= m[2] <= best[1])]
            want[s, b[i][1]] = {k + 1: x for k, x in enumerate(found)}
    assert got == want and len(want) > 20


def test_clusters_like_a_loop():
    rng = np.random.default_rng(3)
    values = np.vstack([rng.normal(size=(40, 9)), np.zeros((1, 9)), [[0, 0, 0, 5, 5, 5, 9, 9, 9]]])
    got = learned.clustered(values)
    for row, own in zip(values.tolist(), got.tolist(), strict=True):
        q = statistics.quantiles(row, n=4, method="inclusive")
        while True:
            mine = [min(range(3), key=lambda k: (abs(v - q[k]), k)) for v in row]  # noqa: B023
            new = [statistics.fmean([v for v, m in zip(row, mine, strict=True) if m == k]) if k in mine else q[k] for k in range(3)]
            if np.allclose(new, q, atol=1e-12):
                break
            q = new
        assert own == mine


def test_clustered_trend_like_a_loop(spark):
    data = walk(2, 120)
    bars = spark.createDataFrame(data, SCHEMA)
    factors, n, memory = [1.0, 1.5, 2.0, 2.5, 3.0], 5, 6
    grid = {(r.symbol, r.bar, r.factor): r for r in learned.factor_grid(bars, factors, n, memory).collect()}
    got = {(r.symbol, r.bar): r for r in learned.clustered_trend(bars, factors, n, memory).collect()}
    assert len(got) == len(data)
    for s in "AB":
        b = [r for r in data if r[0] == s]
        atr, up, dn, way, factor = None, math.nan, math.nan, 0.0, None
        for i, (_, _, bar, _, high, low, close, _) in enumerate(b):
            before = b[i - 1][6] if i else math.nan
            wide = high - low if not i else max(high - low, abs(high - before), abs(low - before))
            atr = wide if atr is None else atr + (wide - atr) / n
            r = got[s, bar]
            if i < n - 1:
                assert r.cluster_factor is None and r.cluster_line is None
                continue
            perf = np.array([[grid[s, bar, f].perf for f in factors]])
            own = learned.clustered(perf)[0] == 2
            factor = float(np.mean(np.array(factors)[own])) if own.any() else factor
            if factor is None:  # nothing has been earned yet, so all are one cluster
                assert r.cluster_factor is None and r.cluster_line is None
                continue
            assert abs(r.cluster_factor - factor) < 1e-12
            u, v = (high + low) / 2 + atr * factor, (high + low) / 2 - atr * factor
            way = 1.0 if close > up else 0.0 if close < dn else way
            up, dn = (min(u, up) if before < up else u), (max(v, dn) if before > dn else v)
            assert abs(r.cluster_line - (dn if way else up)) < 1e-9 and r.cluster_trend == way


@pytest.mark.parametrize("chunk", [1, 70, 10_000])
def test_neighbours_like_a_loop(spark, chunk):
    data = walk(5, 150)
    bars = spark.createDataFrame(data, SCHEMA).withColumns({"f1": F.when(F.col("bar") > 6, F.col("close") - F.col("open")), "f2": F.col("high") - F.col("low")})
    back, k, every = 40, 4, 4
    got = {(r.symbol, r.bar): (r.lorentzian_vote, r.lorentzian_signal) for r in learned.neighbours(bars, ["f1", "f2"], back, k, every, 4, chunk).collect()}
    assert len(got) == len(data)
    for s in "AB":
        b = [r for r in data if r[0] == s]
        f = [(r[6] - r[3], r[4] - r[5]) if r[2] > 6 else None for r in b]
        label = [0 if i < 4 else (b[i][6] > b[i - 4][6]) - (b[i][6] < b[i - 4][6]) for i in range(len(b))]
        signal = 0.0
        for i in range(len(b)):
            if f[i] is None:
                assert got[s, i + 1] == (None, signal)
                continue
            seen, votes, counts = [], [], -1.0
            for j in range(max(0, i - back), i):
                if f[j] is None or b[j][2] % every == 0:
                    continue
                far = sum(math.log1p(abs(x - y)) for x, y in zip(f[i], f[j], strict=True))
                if far >= counts:
                    counts = far
                    seen.append(far)
                    votes.append(label[j])
                    if len(seen) > k:
                        counts = seen[round(k * 3 / 4)]
                        seen, votes = seen[1:], votes[1:]
            signal = signal if sum(votes) == 0 else float(np.sign(sum(votes)))
            assert got[s, i + 1] == (float(sum(votes)), signal), (s, i, chunk)


@pytest.mark.parametrize(("n", "last"), [(2, 3), (3, 6), (4, 2)])
def test_trend_lines_like_all_pairs(n, last):
    rng = np.random.default_rng(n)
    close = np.cumsum(rng.normal(size=250)) + np.arange(250) * 0.05
    low = close - rng.random(250) * (rng.random(250) < 0.7)
    pivots = np.array([low[i] if n <= i < 250 - n and low[i] == low[i - n : i + n + 1].min() else np.nan for i in range(250)])
    value, slope = zones.lines(pivots, close, n, last)
    found = 0
    for i in range(250):
        known = [k for k in range(i - n + 1) if not np.isnan(pivots[k])][-last:]
        want = None
        for a in reversed(range(1, len(known))):
            for b in range(a):
                x1, x2 = known[a], known[b]
                m = (pivots[x1] - pivots[x2]) / (x1 - x2)
                if m > 0 and all(close[k] >= pivots[x2] + m * (k - x2) - 1e-9 for k in range(x2, i + 1)):
                    want = want or (pivots[x2] + m * (i - x2), m)
        if want is None:
            assert np.isnan(value[i]) and np.isnan(slope[i])
        else:
            found += 1
            assert abs(value[i] - want[0]) < 1e-9 and abs(slope[i] - want[1]) < 1e-12
    assert found > 20


def test_empty_bars(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert zones.order_blocks(none).count() == 0 and zones.channels(none).count() == 0 and zones.trend_lines(none).count() == 0 and zones.swing_zones(none, none, 60).count() == 0
    assert learned.clustered_trend(none).count() == 0 and learned.neighbours(none, ["close"]).count() == 0
