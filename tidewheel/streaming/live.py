"""Live bars and trades. All state is bounded by watermarks; sinks are idempotent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewheel.operators.bars import latest_wins
from tidewheel.sources.tables import upsert_bars


def tumbling_bars(ticks: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Bars of (symbol, ts, price, size, seq) ticks; in append mode each is emitted once, when its window is closed."""
    rows = ticks.withWatermark("ts", late).withColumn("at", F.struct("ts", "seq"))
    bars = rows.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("size").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def once(trades: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Trades without repeats within the watermark."""
    return trades.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def trade_deltas(trades: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(0.0))
    out = trades.withWatermark("ts", late).groupBy("coin", F.window("ts", width).alias("w")).agg(side("B").alias("buy_volume"), side("A").alias("sell_volume"))
    return out.select("coin", F.col("w.start").alias("ts"), "buy_volume", "sell_volume", (F.col("buy_volume") - F.col("sell_volume")).alias("delta"))


def upserting(rows: DataFrame, keys: list[str], order: list[str], merge: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes each micro-batch's latest row per key through ``merge(batch, id)``; a repeated batch merges to the same."""

    def each(batch: DataFrame, number: int) -> None:
        merge(latest_wins(batch, keys, [F.col(c) for c in order]), number)

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def appending(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Parquet sink, exactly once."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def following(bars: DataFrame, path: str, staging: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keeps a partitioned bar table up with a stream of bars: each micro-batch upserts the months it touches, and a restart goes on from the checkpoint."""
    return upserting(bars, ["symbol", "ts"], ["ts"], lambda batch, number: upsert_bars(batch, path, f"{staging}/batch={number}"), checkpoint, available_now)
