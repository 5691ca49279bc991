"""Bars that go on from what is stored, fill their gaps, and meet the tape."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import bars as ops
from tidewheel.operators import micro
from tidewheel.queries.base import HOURLY, c, hourly, lag, query, r6, shown, table

MIDDLE = "2024-01-10 00:00:00"


@query("resume_from_watermark", f"WITH {HOURLY}, k AS (SELECT symbol, max(ts) AS last FROM b WHERE ts < '{MIDDLE}'::TIMESTAMP AND symbol <> 'view' GROUP BY symbol) SELECT b.symbol, b.ts, {r6('close')} AS close FROM b LEFT JOIN k ON k.symbol = b.symbol WHERE k.last IS NULL OR b.ts > k.last")
def resume_from_watermark(s, d):
    """Hourly bars after each symbol's last stored one; one symbol has none stored."""
    bars = hourly(s, d)
    stored = bars.where((c("ts") < F.lit(MIDDLE).cast("timestamp_ntz")) & (c("symbol") != "view"))
    return shown(ops.resumed(bars, stored), "close")


@query("gap_catch_up", f"WITH {HOURLY}, k AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM b WHERE bar % 7 <> 0 GROUP BY symbol) SELECT b.symbol, b.ts, {r6('close')} AS close FROM b JOIN k ON k.symbol = b.symbol AND b.ts BETWEEN lo AND hi")
def gap_catch_up(s, d):
    """Bars of which every seventh is missing, filled from the whole."""
    bars = hourly(s, d)
    return shown(ops.caught_up(bars.where("bar % 7 <> 0"), bars, 3600), "close")


@query("tape_on_bars", f"""WITH {HOURLY}, t AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END) AS bv, sum(CASE WHEN user_id % 2 = 0 THEN 0 ELSE value END) AS sv FROM events GROUP BY 1, 2),
 q AS (SELECT *, {lag('ts')} AS p FROM b) SELECT q.symbol, q.ts, {r6('t.bv')} AS buy_volume, {r6('t.sv')} AS sell_volume, {r6('t.bv - t.sv')} AS delta FROM q LEFT JOIN t ON t.symbol = q.symbol AND t.ts = q.p""")
def tape_on_bars(s, d):
    """Hourly bars with the bought and sold size of the bar before."""
    e = table(s, d, "events")
    tape = e.select(c("event_type").alias("coin"), "ts", F.when(c("user_id") % 2 == 0, "B").otherwise("A").alias("side"), c("value").alias("price"), c("value").alias("size"))
    names = ["buy_volume", "sell_volume", "delta"]
    return shown(ops.with_tape(hourly(s, d), micro.trade_delta(tape, 60), names), *names)
