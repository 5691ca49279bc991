"""Online state, as-of joins and the paging stream."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import bars as ops
from tidewheel.operators import recursive
from tidewheel.sources import replay
from tidewheel.streaming import live, online

BARS = "symbol string, ts timestamp_ntz, high double, low double, close double"


def stamps(*minutes):
    return [pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m) for m in minutes]


def run_online(spark, at, files, **how):
    for rows in files:
        made = spark.createDataFrame([(s, t.to_pydatetime(), *v) for s, t, *v in rows], BARS)
        made.coalesce(1).write.mode("append").parquet(f"{at}/in")
        with online.rocksdb(spark):
            stream = spark.readStream.schema(BARS).parquet(f"{at}/in")
            live.appending(online.indicators(stream, **how), f"{at}/out", f"{at}/state", available_now=True).awaitTermination()
    return spark.read.schema(online.OUT).parquet(f"{at}/out").orderBy("symbol", "ts").toPandas()


def test_online_values_go_on_after_restarts_and_late_bars_give_nothing(spark, tmp_path):
    rng = random.Random(2)
    frame = pd.DataFrame({"close": [100 + rng.gauss(0, 3) for _ in range(60)]})
    frame["high"], frame["low"] = frame["close"] + 1 + frame["close"] % 1, frame["close"] - 1
    rows = [("A", t, h, low, c) for t, h, low, c in zip(stamps(*range(0, 300, 5)), frame["high"], frame["low"], frame["close"], strict=True)]
    mixed = [rows[3], rows[2], rows[1], rows[0]]
    late = [("A", rows[10][1], 900.0, 1.0, 500.0)]
    got = run_online(spark, tmp_path, [mixed, rows[4:30], [*late, *rows[30:]]], span=5, wilder=4)
    assert len(got) == 60
    sar, side = recursive.stop_and_reverse(frame["high"].to_numpy(), frame["low"].to_numpy(), 0.02, 0.02, 0.2)
    want = pd.DataFrame({"ema": recursive.ema(frame["close"], 5), "atr": recursive.wilder(recursive.range_of(frame), 4), "sar": sar, "psar_direction": side})
    pd.testing.assert_frame_equal(got[list(want)], want, atol=1e-9, rtol=0)
    before = "spark.sql.streaming.stateStore.providerClass"
    assert "RocksDB" not in (spark.conf.get(before, "") or "")


def test_a_silent_symbol_is_forgotten(spark, tmp_path):
    early = [("A", stamps(0)[0], 2.0, 1.0, 1.5), ("B", stamps(0)[0], 2.0, 1.0, 1.5)]
    later = [[("B", stamps(m)[0], 2.0, 1.0, 1.5)] for m in (50, 200, 240)]
    got = run_online(spark, tmp_path, [early, *later, [("A", stamps(260)[0], 9.0, 8.0, 8.5)]], span=1, wilder=1, idle_seconds=6000)
    a = got[got["symbol"] == "A"]
    assert a["ema"].tolist() == [1.5, 8.5] and a["psar_direction"].tolist() == [0.0, 0.0] and a["sar"].isna().all()
    assert len(got[got["symbol"] == "B"]) == 4


@pytest.mark.parametrize(("part", "tolerance"), [("hour", None), ("day", 3600), ("month", 0), ("month", 7 * 86400)])
def test_as_of_like_a_loop(spark, part, tolerance):
    rng = random.Random(5)
    t0 = pd.Timestamp("2024-01-30")
    at = lambda k: (t0 + pd.Timedelta(minutes=7 * k)).to_pydatetime()
    rows = [(s, at(rng.randrange(2000)), float(i)) for i, s in enumerate(rng.choices(["A", "B", "C", None], k=200))] + [("A", None, -1.0), ("A", at(5), -2.0), ("A", at(5), -2.0)]
    right = [(s, at(rng.randrange(2000)), rng.random(), None if rng.random() < 0.2 else "x") for s in rng.choices(["A", "B"], k=60)] + [("A", at(5), 0.5, "tie"), ("A", at(5), 0.9, "tie"), ("A", None, 1.0, "x"), (None, at(3), 1.0, "x")]
    left = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, n double").withColumn("_v0", F.lit("mine")).withColumn("_t", F.lit(1))
    got = ops.as_of(left, spark.createDataFrame(right, "symbol string, ts timestamp_ntz, rate double, note string"), ["rate", "note"], tolerance, part, at="met")
    assert got.columns == ["symbol", "ts", "n", "_v0", "_t", "rate", "note", "met"]
    want = []
    for s, t, n in rows:
        found = [(rt, v, note or "") for rs, rt, v, note in right if rs == s and s is not None and rt is not None and t is not None and rt <= t]
        best = max(found, default=None)
        if best and tolerance is not None and (t - best[0]).total_seconds() > tolerance:
            best = None
        want.append((str(s), str(t), n, *((best[1], best[2] or None, best[0]) if best else (None, None, None))))
    assert sorted(((str(r.symbol), str(r.ts), r.n, r.rate, r.note, r.met) for r in got.collect()), key=str) == sorted(want, key=str)


def page(folder, symbol, first, times):
    (folder / symbol).mkdir(parents=True, exist_ok=True)
    (folder / symbol / f"{first}.json").write_text(json.dumps([[t, 1, 2, 0.5, 1.5, 9] for t in times]))


@pytest.mark.parametrize("most", [None, 1, 2])
def test_paging_stream_goes_on_without_repeats_or_holes(spark, tmp_path, most):
    spark.dataSource.register(replay.CandlePages)
    pages, out, state = tmp_path / "pages", f"{tmp_path}/out", f"{tmp_path}/state"
    pages.mkdir()

    def more():
        stream = spark.readStream.format("candle_pages").option("path", f"file://{pages}").option("since", "10")
        stream = (stream.option("pagesPerBatch", str(most)) if most else stream).load()
        for _ in range(4 if most else 1):
            live.appending(stream, out, state, available_now=True).awaitTermination()
        return sorted((r.symbol, r.timestamp) for r in spark.read.schema(replay.SCHEMA).parquet(out).collect())

    page(pages, "A", 0, [0, 10, 20])
    page(pages, "A", 20, [30, 20, 40])
    assert more() == [("A", t) for t in (10, 20, 30, 40)]
    page(pages, "A", 40, [])
    page(pages, "A", 50, [40, 50, 60])
    page(pages, "B", 5, [5, 15])
    want = [("A", t) for t in (10, 20, 30, 40, 50, 60)] + [("B", 15)]
    assert more() == want and more() == want
    batch = spark.read.format("candle_pages").option("path", str(pages)).option("since", "10").load()
    assert sorted((r.symbol, r.timestamp) for r in batch.collect()) == want


def test_requests_are_made_again():
    calls = []

    def ask():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "page"

    assert replay.tried(ask, wait=0.001) == "page" and len(calls) == 3
    with pytest.raises(OSError):
        replay.tried(lambda: (_ for _ in ()).throw(OSError("gone")), tries=2, wait=0.001)
