"""Tables, parsers, the paging source and models on small inputs."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import evaluate, model
from tidewheel.queries import trading
from tidewheel.sources import replay, tables
from tidewheel.streaming import live


def bars(spark, rows):
    return spark.createDataFrame([(s, pd.Timestamp(t).to_pydatetime(), *[float(p)] * 4, 1.0) for s, t, p in rows], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_upsert_touches_months_and_new_wins(spark, tmp_path):
    p = f"file://{tmp_path}/bars"
    assert tables.scan(spark, p).count() == 0
    tables.write_bars(bars(spark, [("A", "2024-01-01", 1), ("A", "2024-02-01", 2)]), p)
    tables.upsert_bars(bars(spark, [("A", "2024-02-01", 3), ("A", "2024-02-02", 4)]), p, f"file://{tmp_path}/stage")
    assert sorted(r.close for r in tables.scan(spark, p).collect()) == [1.0, 3.0, 4.0]
    assert [r.close for r in tables.scan_range(spark, p, "A", "2024-02-01", "2024-02-01").collect()] == [3.0]
    tables.snapshot(spark, p, f"file://{tmp_path}/snap", until="2024-01-31")
    assert [r.timestamp for r in spark.read.parquet(f"{tmp_path}/snap").collect()] == [1704067200000]


def test_trades_insert_once(spark, tmp_path):
    schema = "coin string, ts timestamp, trade_id long, price double, size double, side string"
    rows = spark.createDataFrame([("X", pd.Timestamp("2024-01-01").to_pydatetime(), 1, 1.0, 1.0, "B")] * 2, schema)
    tables.insert_trades(rows, f"file://{tmp_path}/t")
    tables.insert_trades(rows, f"file://{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1


def test_parsers_skip_malformed(spark):
    good = json.dumps({"channel": "trades", "data": [{"time": 1700000000000, "coin": "X", "tid": 5, "side": "B", "px": "1.5", "sz": "2"}, {"time": 1, "coin": "X", "tid": 6, "side": "?", "px": "a", "sz": "2"}]})
    raw = spark.createDataFrame([(good,), ("{not json",), (json.dumps({"channel": "book"}),), (None,)], "value string")
    assert [(r.coin, r.price, r.size) for r in tables.parsed_trades(raw).collect()] == [("X", 1.5, 2.0)]
    fund = json.dumps([{"universe": [{"name": "X"}, {"name": "Y"}]}, [{"funding": "0.1", "openInterest": "7"}, {"funding": "-0.2"}]])
    got = tables.parsed_funding(spark.createDataFrame([(fund,)], "value string"), F.lit("2024-01-01 05:30:00").cast("timestamp")).collect()
    assert [(r.coin, r.funding_rate, r.open_interest) for r in got] == [("X", 0.1, 7.0), ("Y", -0.2, None)]


def test_paging_source(spark, tmp_path):
    for s in ("A", "B"):
        (tmp_path / s).mkdir()
        for k, rows in {0: [[0, 1, 2, 0.5, 1.5, 9], [60, 1, 2, 0.5, 1.5, 9]], 60: [[60, 1, 2, 0.5, 1.5, 9], [120, 1, 2, 0.5, 1.6, 9]]}.items():
            (tmp_path / s / f"{k}.json").write_text(json.dumps(rows))
    spark.dataSource.register(replay.CandlePages)
    got = spark.read.format("candle_pages").option("path", str(tmp_path)).option("until", "121").load()
    assert sorted((r.symbol, r.timestamp) for r in got.collect()) == [(s, t) for s in "AB" for t in (0, 60, 120)]


def test_paging_from_beyond_the_third_page(spark, tmp_path):
    (tmp_path / "A").mkdir()
    for k in range(8):
        (tmp_path / "A" / f"{k * 60}.json").write_text(json.dumps([[k * 60 + j, 1, 2, 0.5, 1.5, 9] for j in (0, 30)] if k != 1 else []))
    spark.dataSource.register(replay.CandlePages)
    got = spark.read.format("candle_pages").option("path", str(tmp_path)).option("since", "270").load()
    assert sorted(r.timestamp for r in got.collect()) == [270, 300, 330, 360, 390, 420, 450]


def test_stream_runs_share_no_folder(spark, sf, tmp_path, monkeypatch):
    spark.read.parquet(f"{sf}/events.parquet").limit(50).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://cluster")
    for where in (sf, str(tmp_path), sf):
        events = spark.read.parquet(f"{where}/events.parquet")
        want = {(r.user_id, r.event_id) for r in events.groupBy("user_id").agg(F.max("event_id").alias("event_id")).collect()}
        assert {(r.user_id, r.event_id) for r in trading.stream_upsert(spark, where).collect()} == want
        want = sorted((r.user_id, r.event_type) for r in events.select("user_id", "event_type").distinct().collect())
        assert sorted((r.user_id, r.event_type) for r in trading.stream_dedupe(spark, where).collect()) == want
        assert trading.stream_tumbling_bars(spark, where).columns[0] == "symbol"


def test_follower_goes_on_after_a_restart(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/bars"
    days = [("A", "2024-01-01", 1), ("A", "2024-01-02", 2)], [("A", "2024-01-02", 3), ("B", "2024-02-01", 4)]
    for rows in days:
        bars(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(bars(spark, rows).schema).parquet(source)
        live.following(stream, path, f"file://{tmp_path}/stage", f"file://{tmp_path}/state", available_now=True).awaitTermination()
    assert sorted((r.symbol, r.close) for r in tables.scan(spark, path).collect()) == [("A", 1.0), ("A", 3.0), ("B", 4.0)]


def test_late_ticks_are_dropped(spark, tmp_path):
    schema = "symbol string, ts timestamp, price double, size double, seq long"
    batches = [[("A", "2024-01-01 00:10:00", 1.0, 1)], [("A", "2024-01-01 03:00:00", 2.0, 2)], [("A", "2024-01-01 00:20:00", 9.0, 3), ("A", "2024-01-01 03:01:00", 3.0, 4)], [("A", "2024-01-01 06:00:00", 5.0, 5)]]
    for k, rows in enumerate(batches):
        made = spark.createDataFrame([(s, pd.Timestamp(t).to_pydatetime(), p, 1.0, q) for s, t, p, q in rows], schema)
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        live.appending(live.tumbling_bars(stream, "1 hour"), f"{tmp_path}/out", f"{tmp_path}/state", available_now=True).awaitTermination()
    got = {r.ts.hour: (r.volume, r.high) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: (1.0, 1.0), 3: (2.0, 3.0)}


def test_database_upsert(spark, tmp_path):
    url, props = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    first = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0)], "coin string, at long, rate double")
    first.write.option("createTableColumnTypes", "coin VARCHAR(255)").jdbc(url, "rates", properties=props)
    tables.merge_jdbc(spark.createDataFrame([("A", 2, 5.0), ("B", 1, 7.0)], first.schema), url, "rates", ["coin", "at"], "rates_new", props)
    assert sorted(tuple(r) for r in tables.from_jdbc(spark, url, "rates", props).collect()) == [("A", 1, 1.0), ("A", 2, 5.0), ("B", 1, 7.0)]


def test_state_lookup(spark):
    state = spark.createDataFrame([("c", "k", None, "ok", None, None), ("c", "l", None, "bad", None, None)], tables.STATE)
    assert [r.last_status for r in tables.state_of(state, "c", "l").collect()] == ["bad"]


def test_boosted_model_is_saved_and_loaded(spark, tmp_path):
    rows = spark.range(240).select(F.lit("A").alias("symbol"), F.col("id").alias("ts"), (F.col("id") % 97 / 97.0 * 3).alias("f"), (F.col("id") % 13).cast("double").alias("g")).withColumn("label", F.floor("f").cast("int")).cache()
    m = model.train_boosted(rows, ["f", "g"], rounds=3, depth=2)
    m.save(f"file://{tmp_path}/m")
    a, b = (model.scored(x, rows, ["f", "g"]).orderBy("ts").select("p0", "p1", "p2").collect() for x in (m, model.OneVsRest.load(f"file://{tmp_path}/m")))
    assert a == b and all(abs(sum(r) - 1) < 1e-9 for r in a)
    assert evaluate.log_loss(model.scored(m, rows, ["f", "g"])).first()[0] < 0.6
    parts = model.contributions(m, rows, ["f", "g"])
    assert parts.count() == 240 and parts.agg(F.max(F.abs("contribution_g"))).first()[0] < parts.agg(F.max(F.abs("contribution_f"))).first()[0]


def test_models_learn_and_calibrate(spark):
    rows = spark.range(600).select(F.lit("A").alias("symbol"), F.col("id").alias("ts"), (F.rand(1) * 3).alias("f"), F.rand(2).alias("noise")).withColumn("label", F.floor("f").cast("int"))
    rows = rows.withColumn("noise", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("noise"))) if "id" in rows.columns else rows
    rows.cache()
    m = model.train(rows, ["f", "noise"], trees=8, depth=4)
    scored = model.scored(m, rows, ["f", "noise"]).cache()
    assert evaluate.log_loss(scored).first()[0] < 0.4
    done = model.calibrated(model.calibrators(scored), scored)
    assert abs(done.agg(F.avg(F.col("p0") + F.col("p1") + F.col("p2"))).first()[0] - 1) < 1e-9
    assert evaluate.log_loss(done).first()[0] <= evaluate.log_loss(scored).first()[0] + 1e-6
    imp = {r.feature: r.importance for r in model.importance(m, rows, ["f", "noise"]).collect()}
    assert imp["f"] > 0.3 > abs(imp["noise"]) + 0.1
    with pytest.raises(ValueError):
        model.train(rows, ["absent"])


def test_latest_file_by_number(spark, tmp_path):
    for name in ("fold_9.txt", "fold_10.txt", "fold_0011.txt", "fold_x.txt", "fold_12.json", "other_99.txt", "fold_.txt"):
        (tmp_path / name).write_text("x")
    assert tables.latest_file(spark, f"file://{tmp_path}", "fold_", ".txt").endswith("/fold_0011.txt")
    assert tables.latest_file(spark, f"file://{tmp_path}", "none_", ".txt") is None
    assert tables.latest_file(spark, f"file://{tmp_path}/absent", "fold_", ".txt") is None
