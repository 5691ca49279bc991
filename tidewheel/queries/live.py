"""Online state, and what stood at or before a bar."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import bars as ops
from tidewheel.operators import micro
from tidewheel.queries.base import HOURLY, c, hourly, query, r6, select, shown, table
from tidewheel.queries.series import SAR, series
from tidewheel.queries.trading import fresh
from tidewheel.streaming import live, online

ONLINE = {"ema": "v.m21", "atr": "v.atr", "sar": "s.way * s.stop", "psar_direction": "coalesce(s.way, 0)"}


@query("online_indicators", f"WITH RECURSIVE {series(HOURLY, ('emas', 'atr'))}, {SAR} {select(ONLINE, 'v LEFT JOIN s ON s.symbol = v.symbol AND s.bar = v.bar', 'v.symbol, v.ts')}")
def online_indicators(s, d):
    """Exponential mean, true range and SAR of hourly bars that arrive as a stream of five files."""
    bars, at = hourly(s, d).select("symbol", "ts", "high", "low", "close"), fresh(s, "online")
    part = F.least(F.floor(F.dayofmonth("ts") / 7), F.lit(4))
    for k in range(5):  # one file after the other, as they would arrive
        bars.where(part == k).coalesce(1).write.mode("append").parquet(f"{at}/bars")
    stream = s.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/bars")
    with online.rocksdb(s):
        live.appending(online.indicators(stream), f"{at}/out", f"{at}/state", available_now=True).awaitTermination()
    out = s.read.schema(online.OUT).parquet(f"{at}/out").withColumn("ts", c("ts").cast("timestamp_ntz"))
    return shown(out, "ema", "atr", "sar", "psar_direction")


RATES = "r AS (SELECT event_type AS symbol, ts, value / 1000 - 0.05 AS funding_rate FROM events WHERE user_id % 10 = 3)"


AGE = "CASE WHEN epoch_us(ts) - epoch_us(funding_ts) <= 43200000000 THEN"


@query("funding_on_bars", f"""WITH {HOURLY}, {RATES}, q AS (SELECT b.symbol, b.ts, r.ts AS funding_ts, r.funding_rate FROM b ASOF LEFT JOIN r ON b.symbol = r.symbol AND b.ts >= r.ts)
 SELECT symbol, ts, {AGE} {r6('(epoch_us(ts) - epoch_us(funding_ts)) / 1000000')} END AS funding_age, {AGE} {r6('funding_rate')} END AS funding_rate FROM q""")
def funding_on_bars(s, d):
    """Each hourly bar with the last funding rate at or before its opening and its age in seconds, unless that is more than twelve hours."""
    rates = table(s, d, "events").where("user_id % 10 = 3").select(c("event_type").alias("symbol"), "ts", (c("value") / 1000 - 0.05).alias("funding_rate"))
    met = ops.as_of(hourly(s, d), rates, ["funding_rate"], 12 * 3600, part="week", at="funding_ts")
    micros = lambda x: F.unix_micros(c(x).cast("timestamp"))
    return shown(met.withColumn("funding_age", (micros("ts") - micros("funding_ts")) / 1_000_000), "funding_age", "funding_rate")


FUNDED = "q AS (SELECT b.*, r.funding_rate FROM b ASOF LEFT JOIN r ON b.symbol = r.symbol AND b.ts >= r.ts)"
TREND = {
    "funding_rate_trend": "CASE WHEN count(funding_rate) OVER w = 8 THEN funding_rate - avg(funding_rate) OVER w END", "funding_rate_8h_sum": "CASE WHEN count(funding_rate) OVER w = 8 THEN sum(funding_rate) OVER w END",
    "funding_rate_1h_change": "funding_rate - lag(funding_rate) OVER (PARTITION BY symbol ORDER BY ts)",
}


@query("funding_features", f"WITH {HOURLY}, {RATES}, {FUNDED} {select(TREND, 'q WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)')}")
def funding_features(s, d):
    """Funding features of hourly bars that carry the last rate, whatever its time."""
    rates = table(s, d, "events").where("user_id % 10 = 3").select(c("event_type").alias("symbol"), "ts", (c("value") / 1000 - 0.05).alias("funding_rate"))
    return shown(micro.funding(ops.as_of(hourly(s, d), rates, ["funding_rate"])), *TREND)
