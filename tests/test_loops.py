"""Window forms of state machines against plain loops."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.features import events, statistics, structure
from tidewheel.functions import exprs as x
from tidewheel.operators import folds, labels, recursive
from tidewheel.plans.config import DEFAULT, Config
from tidewheel.plans.matrix import feature_names, matrix


def made(n=400, seed=3, symbols=("A", "B")):
    rng = random.Random(seed)
    rows = []
    for s in symbols:
        p = 100.0
        for i in range(n):
            o = p
            p = max(5.0, round(p * math.exp(rng.gauss(0, 0.01)), 2))
            hi, lo = round(max(o, p) * (1 + abs(rng.gauss(0, 0.004))), 2), round(min(o, p) * (1 - abs(rng.gauss(0, 0.004))), 2)
            rows.append((s, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), o, hi, lo, p, float(rng.randrange(1, 50))))
    return pd.DataFrame(rows, columns=["symbol", "ts", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="module")
def bars(spark):
    df = spark.createDataFrame(made()).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return x.indexed(df)


def each(df, name):
    out = df.select("symbol", "bar", name).toPandas().sort_values(["symbol", "bar"])
    return {s: g[name].tolist() for s, g in out.groupby("symbol")}


def none(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


def alike(a, b):
    assert len(a) == len(b)
    for i, (p, q) in enumerate(zip(a, b)):
        p, q = none(p), none(q)
        assert (p is None) == (q is None) and (p is None or abs(p - q) < 1e-9), (i, p, q)


def fractals(v, top):
    out = [None] * len(v)
    for i in range(4, len(v)):
        w = v[i - 4 : i + 1]
        if v[i - 2] == (max(w) if top else min(w)):
            out[i] = v[i - 2]
    return out


def test_swing_ratio(bars):
    got = each(structure.swings(bars, DEFAULT), "swing_ratio")
    for s, g in made().groupby("symbol"):
        h, l = fractals(g.high.tolist(), True), fractals(g.low.tolist(), False)
        chain, last, want = [], None, []
        for a, b in zip(h, l):
            for v, kind, better in ((a, "H", max), (b, "L", min)):
                if v is None:
                    continue
                if chain and chain[-1][0] == kind:
                    chain[-1] = (kind, better(chain[-1][1], v))
                else:
                    chain.append((kind, v))
            if len(chain) >= 3 and (a is not None or b is not None):
                one, two = abs(chain[-1][1] - chain[-2][1]), abs(chain[-2][1] - chain[-3][1])
                last = one / two if two > 0 else last
            want.append(last)
        alike(got[s], want)


def test_recovery_speed(bars):
    """Exits first; each is completed by its first bar at the middle before the next exit."""
    df = bars.withColumn("v", (F.col("close") - x.lowest("low", 14)) / (x.highest("high", 14) - x.lowest("low", 14)) * 100)
    df = df.withColumn("far", x.flag((F.col("v") > 80) | (F.col("v") < 20)))
    got, v, far = each(events.recovery(df, "v", "far", "speed"), "speed"), each(df, "v"), each(df, "far")
    for s in got:
        y = [none(q) for q in v[s]]
        exits = [e for e in range(1, len(y)) if far[s][e - 1] and not far[s][e]]
        done = {}
        for e, end in zip(exits, [*exits[1:], len(y)]):
            reached = [j for j in range(e, end) if y[j] is not None and (y[j] - 50) * (1 if y[e - 1] <= 50 else -1) >= 0]
            if reached:
                done[reached[0]] = reached[0] - e
        assert len(done) > 5
        alike(got[s], [done.get(max((j for j in done if j <= i), default=None)) for i in range(len(y))])


def test_depth_and_length(bars):
    """Episodes are runs of one kind; a bar reads the extreme of the latest one so far."""
    from tidewheel.features import momentum

    df = events.stochastic(momentum.stochastic(bars, DEFAULT), DEFAULT)
    k, depth, length = each(df, "stoch_k"), each(df, "stoch_last_extreme_depth"), each(df, "stoch_bars_in_ob")
    for s in k:
        y = [none(q) for q in k[s]]
        kinds = ["-" if q is None or 20 <= q <= 80 else "high" if q > 80 else "low" for q in y]
        runs, start = [], 0
        for kind, run in itertools.groupby(kinds):
            n = len(list(run))
            runs.append((start, start + n, kind))
            start += n
        for i in range(len(y)):
            extremes = [(a, min(b, i + 1), kind) for a, b, kind in runs if a <= i and kind != "-"]
            high = [(a, b) for a, b, kind in extremes if kind == "high"]
            want = None
            if extremes:
                a, b, kind = extremes[-1]
                want = max(y[a:b]) - 80 if kind == "high" else 20 - min(y[a:b])
            alike([depth[s][i], length[s][i]], [want, high[-1][1] - high[-1][0] if high else None])


def test_triple_barrier_and_trail(bars):
    g = Config(horizon=12, tp_atr=2.0, sl_atr=1.5, min_profit=0.3, min_profit_of={})
    df = bars.withColumn("atr_14", x.sma(F.col("high") - F.col("low"), 14))
    df = labels.trailing_stop(labels.triple_barrier(df, g), 1.5, 12)
    cols = ("label", "holding_bars", "exit_price", "atr_14", "long_pnl_pct", "short_pnl_pct")
    got = {c: each(df, c) for c in cols}
    for s, b in made().groupby("symbol"):
        hi, lo, cl = (b[c].tolist() for c in ("high", "low", "close"))
        for i, a in enumerate(map(none, got["atr_14"][s])):
            label, held, px = 2, 12, None
            if i + 12 >= len(cl):
                label = -1
            elif a:
                up, down = cl[i] + 2 * a, cl[i] - 1.5 * a
                for j in range(1, 13):
                    if lo[i + j] <= down or hi[i + j] >= up:
                        label, held, px = (1, j, down) if lo[i + j] <= down else (0, j, up)
                        break
                else:
                    px = cl[i + 12]
                    move = (px - cl[i]) / cl[i] * 100
                    label = 0 if move > 0.3 else 1 if move < -0.3 else 2
                for way, name in ((1, "long_pnl_pct"), (-1, "short_pnl_pct")):
                    best, out = cl[i], None
                    for j in range(1, 13):
                        stop = best - way * 1.5 * a
                        if out is None and (lo[i + j] < stop if way > 0 else hi[i + j] > stop):
                            out = stop
                        best = max(best, cl[i + j]) if way > 0 else min(best, cl[i + j])
                    out = cl[i + 12] if out is None else out
                    assert abs(got[name][s][i] - way * (out - cl[i]) / cl[i] * 100) < 1e-9
            assert (got["label"][s][i], got["holding_bars"][s][i]) == (label, held)
            assert none(got["exit_price"][s][i]) == px or abs(got["exit_price"][s][i] - px) < 1e-9


def test_box_dimension_by_sets():
    rng = np.random.default_rng(0)
    v = np.cumsum(rng.normal(size=50))
    y, t = (v - v.min()) / (v.max() - v.min()), np.arange(50) / 49
    n = []
    for k in range(1, 6):
        bx, by = np.floor(t * 2**k).astype(int), np.floor(y * 2**k).astype(int)
        boxes = set(zip(bx.tolist(), by.tolist()))
        for i in range(1, 50):
            if bx[i] != bx[i - 1]:
                boxes |= {(bx[i], q) for q in range(min(by[i - 1], by[i]), max(by[i - 1], by[i]) + 1)}
        n.append(len(boxes))
    assert abs(statistics.box_dimension(v[None])[0] - np.polyfit(np.arange(1, 6) * math.log(2), np.log(n), 1)[0]) < 1e-9


def test_flat_and_short_series(spark):
    flat = pd.DataFrame([("A", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(30)], columns=["symbol", "ts", "open", "high", "low", "close", "volume"])
    df = x.indexed(spark.createDataFrame(flat).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    out = statistics.mean_reversion(recursive.with_series(df, recursive.base_series, DEFAULT), DEFAULT)
    assert out.where("zscore_20 is not null or rsi_14 is not null").count() == 0
    assert recursive.with_series(df.where("bar <= 1"), recursive.base_series, DEFAULT).count() == 1


def test_no_look_ahead_and_303_features(spark, tmp_path):
    b = made(260, 5, ("A",))
    df = spark.createDataFrame(b).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    n = [0]

    def cut(d):
        n[0] += 1
        d.write.parquet(f"{tmp_path}/{n[0]}")
        return spark.read.schema(d.schema).parquet(f"{tmp_path}/{n[0]}")

    whole = cut(matrix(df, unit="day", cut=cut))
    names = feature_names(whole)
    assert len(names) == 303
    part = cut(matrix(df.where(F.col("ts") < "2024-01-10"), unit="day", cut=cut)).toPandas().sort_values("ts")
    same = whole.where(F.col("ts") < "2024-01-10").toPandas().sort_values("ts")
    for c in names:
        alike(part[c].astype(float).tolist(), same[c].astype(float).tolist())


def test_folds_do_not_overlap(bars):
    f = folds.walk_forward(bars, 0, 0, 1, 5).limit(1)
    parts = folds.in_folds(bars, f.select("symbol", "fold", "train_start", "train_end", "val_start", "val_end"))
    assert parts.where("part = 'train' and part = 'val'").count() == 0
