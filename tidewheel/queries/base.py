"""What the queries share: bars from the tables, rounding, and the same bars in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.exprs import indexed
from tidewheel.operators.bars import from_ticks

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Decimals that are compared.
DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars: a symbol per event type, the value as price, one unit of volume per event."""
    e = table(spark, sf_dir, "events")
    return indexed(from_ticks(e, c("event_type"), c("ts"), c("value"), F.lit(1.0), [c("ts"), c("event_id")]))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars over seven years: a symbol per return flag, the unit price in another currency (so that decimals do not end on a half), quantity as volume."""
    x = table(spark, sf_dir, "lineitem")
    return indexed(from_ticks(x, c("l_returnflag"), c("l_shipdate"), c("l_extendedprice") / c("l_quantity") / 9.973, c("l_quantity"), [c("l_orderkey"), c("l_linenumber")], "day"))


HOURLY = """b AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar FROM (
    SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
      last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
    FROM events GROUP BY event_type, date_trunc('hour', ts)))"""
DAILY = """b AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar FROM (
    SELECT symbol, ts, first(p ORDER BY l_orderkey, l_linenumber) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY l_orderkey, l_linenumber) AS close, sum(v) AS volume
    FROM (SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate) AS ts, l_extendedprice / l_quantity / 9.973::DOUBLE AS p, l_quantity AS v, l_orderkey, l_linenumber FROM lineitem)
    GROUP BY symbol, ts))"""


def near(x: Column) -> Column:
    """A double to six decimals as SQL does it: scaled first, so that what a double can't hold exactly (0.0731225) is still a half."""
    scaled = x * 10.0**DIGITS
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / 10.0**DIGITS).otherwise(x)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, minus zero as zero."""
    return df.select(*[(near(c(n)) + F.lit(0.0)).alias(n) if k == "double" else c(n).cast("long").alias(n) if k == "int" else c(n) for n, k in df.dtypes])


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); ``sql`` is the oracle."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            ORACLES[name] = sql
        return f

    return put


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


LAG = "OVER (PARTITION BY symbol ORDER BY ts)"
SOFAR = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {LAG}"


def full(f: str, x: str, n: int) -> str:
    """The aggregate over the last n rows, null until n values are there."""
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {f}({x}) {over(n)} END"


def r6(x: str) -> str:
    return f"round(({x})::DOUBLE, {DIGITS}) + 0.0::DOUBLE"


def select(columns: dict[str, str], source: str, keys: str = "symbol, ts") -> str:
    """SELECT with doubles rounded."""
    return f"SELECT {keys}, " + ", ".join(f"{r6(x)} AS {n}" for n, x in columns.items()) + f" FROM {source}"


def shown(df: DataFrame, *names: str) -> DataFrame:
    return df.select("symbol", "ts", *names)
