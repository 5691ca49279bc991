"""Indicators that go on from bar to bar: one row of typed state a symbol, forgotten when the symbol stays silent.

The batch columns of the same names come from ``operators.recursive``; a stream in any number of files gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "symbol string, ts timestamp, ema double, atr double, sar double, psar_direction double"


@dataclass
class Run:
    """What a symbol's next bar needs of all bars before it."""

    n: int = 0
    last_ms: int = 0
    close: float = 0.0
    ema: float = 0.0
    atr: float = 0.0
    way: float = 0.0
    stop: float = 0.0
    extreme: float = 0.0
    pace: float = 0.0
    high1: float = 0.0
    low1: float = 0.0
    high2: float = 0.0
    low2: float = 0.0

    def add(self, high: float, low: float, close: float, span: int, wilder: int, sar: tuple[float, float, float]) -> tuple[float | None, ...]:
        """Takes the next bar in; (ema, atr, sar, direction) as they are then, null while they warm up."""
        start, step, most = sar
        first = self.n == 0
        wide = high - low if first else max(high - low, abs(high - self.close), abs(low - self.close))
        self.ema = close if first else self.ema + 2.0 / (span + 1) * (close - self.ema)
        self.atr = wide if first else self.atr + (wide - self.atr) / wilder
        if self.n == 1:
            self.way = 1.0 if high >= self.high1 else -1.0
            self.stop, self.extreme, self.pace = self._near(self.high1, self.low1), self._far(high, low), start
        elif self.n > 1:
            due = min(self.stop + self.pace * (self.extreme - self.stop), self._near(self.high1, self.low1), self._near(self.high2, self.low2))
            if self._near(high, low) < due:
                self.stop, self.way = -self.extreme, -self.way
                self.extreme, self.pace = self._far(high, low), start
            else:
                self.stop = due
                if self._far(high, low) > self.extreme:
                    self.extreme, self.pace = self._far(high, low), min(self.pace + step, most)
        self.high2, self.low2, self.high1, self.low1, self.close = self.high1, self.low1, high, low, close
        self.n += 1
        ready = self.n > 1
        return self.ema if self.n >= span else None, self.atr if self.n >= wilder else None, self.way * self.stop if ready else None, self.way

    def _near(self, high: float, low: float) -> float:
        """The edge that the stop follows; a short side is a long one mirrored."""
        return low if self.way > 0 else -high

    def _far(self, high: float, low: float) -> float:
        return high if self.way > 0 else -low


STATE = ", ".join(f"{f.name} {'bigint' if f.type == 'int' else 'double'}" for f in fields(Run))


class Indicators(StatefulProcessor):
    """Adds each symbol's new bars to its state. Bars not after the symbol's last one are late and give nothing."""

    def __init__(self, span: int, wilder: int, sar: tuple[float, float, float], idle_ms: int):
        self.how, self.idle_ms = (span, wilder, sar), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run = Run(*self.run.get()) if self.run.exists() else Run()
        bars = pd.concat(list(rows)).sort_values("ts", kind="stable")
        out = []
        for ms, ts, high, low, close in zip(bars["ts"].astype("datetime64[ms]").astype("int64").tolist(), bars["ts"], bars["high"].tolist(), bars["low"].tolist(), bars["close"].tolist(), strict=True):
            if run.n and ms <= run.last_ms:
                continue
            out.append((key[0], ts, *run.add(high, low, close, *self.how)))
            run.last_ms = ms
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if self.idle_ms:
            self.handle.registerTimer(run.last_ms + self.idle_ms)
        self.run.update(tuple(asdict(run).values()))
        yield pd.DataFrame(out, columns=["symbol", "ts", "ema", "atr", "sar", "psar_direction"]).astype({c: "float64" for c in ("ema", "atr", "sar", "psar_direction")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.run.clear()
        yield from ()

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """State of any type needs the RocksDB store; the setting is as before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def indicators(bars: DataFrame, span: int = 21, wilder: int = 14, sar: tuple[float, float, float] = (0.02, 0.02, 0.2), late: str = "0 seconds", idle_seconds: int = 0) -> DataFrame:
    """(symbol, ts, ema, atr, sar, psar_direction) for a stream of closed bars (symbol, ts, high, low, close), bar by bar.

    Start the query within ``rocksdb``.  A symbol's bars have to come in the order of their time from batch to batch; within one they may be
    mixed.  With ``idle_seconds`` a symbol without a bar for so long (by the watermark) is forgotten and warms up anew.
    """
    rows = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "high", "low", "close").withWatermark("ts", late)
    return rows.groupBy("symbol").transformWithStateInPandas(statefulProcessor=Indicators(span, wilder, sar, 1000 * idle_seconds), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
