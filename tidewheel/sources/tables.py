"""Partitioned Parquet tables of bars and state: scans, upserts, snapshots, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.operators.bars import OHLCV, first_wins, latest_wins

STATE = "collector string, key string, last_ts timestamp_ntz, last_status string, last_error string, updated_at timestamp_ntz"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, path: str, schema: str = OHLCV) -> DataFrame:
    """A Parquet table, or an empty one of the schema where there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def scan_range(spark: SparkSession, path: str, symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a symbol and time range, both ends included; each bound is optional and pushed to the scan."""
    df = scan(spark, path)
    for given, condition in ((symbol, F.col("symbol") == symbol), (start, F.col("ts") >= F.lit(start).cast("timestamp_ntz")), (end, F.col("ts") <= F.lit(end).cast("timestamp_ntz"))):
        df = df if given is None else df.where(condition)
    return df


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Bars by symbol and month; of repeated keys the last read wins. Only the partitions that are written are replaced."""
    out = bars.withColumn("month", F.date_format("ts", "yyyy-MM"))
    out.repartition("symbol", "month").sortWithinPartitions("symbol", "ts").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "month").parquet(path)


def upsert_bars(new: DataFrame, path: str, staging: str) -> None:
    """Merges bars by (symbol, ts), new ones winning. Only the touched months are read and replaced; they pass through ``staging``."""
    spark = new.sparkSession
    new = latest_wins(new.withColumn("_new", F.lit(1)), ["symbol", "ts"], [F.col("_new")])
    touched = new.select("symbol", F.date_format("ts", "yyyy-MM").alias("month")).distinct()
    old = scan(spark, path, OHLCV + ", month string")
    old = old.join(touched, ["symbol", "month"], "left_semi").drop("month").withColumn("_new", F.lit(0))
    latest_wins(new.unionByName(old), ["symbol", "ts"], [F.col("_new")]).drop("_new").write.mode("overwrite").parquet(staging)
    write_bars(spark.read.parquet(staging), path)


def insert_trades(new: DataFrame, path: str) -> None:
    """Appends trades whose (coin, ts, trade_id, price, size) isn't there yet."""
    keys = ["coin", "ts", "trade_id", "price", "size"]
    spark = new.sparkSession
    rows = first_wins(new, spark.read.parquet(path), keys) if exists(spark, path) else new.dropDuplicates(keys)
    rows.write.mode("append").parquet(path)


def snapshot(spark: SparkSession, path: str, out: str, since: str | None = None, until: str | None = None) -> None:
    """Exports a time range with millisecond timestamps: what training reads."""
    df = scan_range(spark, path, None, since, until)
    df.select("symbol", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), "open", "high", "low", "close", "volume").write.mode("overwrite").partitionBy("symbol").parquet(out)


def from_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str], column: str | None = None, bounds: tuple[str, str] | None = None, parts: int = 8) -> DataFrame:
    """A database table; with a column and its bounds it is read in parallel ranges, and filters are pushed down."""
    if column and bounds:
        reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, **properties)
        return reader.load()
    return spark.read.jdbc(url, table, properties=properties)


def merge_jdbc(rows: DataFrame, url: str, table: str, keys: list[str], staging: str, properties: dict[str, str]) -> None:
    """Upserts rows into a database table: they are written to ``staging`` in parallel, and one MERGE takes them over by ``keys``, new ones winning."""
    # Keys must be comparable: databases keep plain strings as large objects otherwise.
    kinds = ", ".join(f"{f.name} VARCHAR(255)" for f in rows.schema.fields if f.name in keys and f.dataType == T.StringType())
    write = latest_wins(rows, keys, [F.lit(1)]).write
    (write.option("createTableColumnTypes", kinds) if kinds else write).jdbc(url, staging, mode="overwrite", properties=properties)
    quoted = lambda c, of="": f'{of}"{c}"'
    values = [c for c in rows.columns if c not in keys]
    on = " AND ".join(f"{quoted(k, 't.')} = {quoted(k, 's.')}" for k in keys)
    sets = ", ".join(f"{quoted(v)} = {quoted(v, 's.')}" for v in values)
    names, fresh = ", ".join(map(quoted, rows.columns)), ", ".join(quoted(c, "s.") for c in rows.columns)
    jvm = rows.sparkSession.sparkContext._jvm
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        update = f"WHEN MATCHED THEN UPDATE SET {sets} " if values else ""
        connection.createStatement().execute(f"MERGE INTO {table} t USING {staging} s ON {on} {update}WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({fresh})")
    finally:
        connection.close()


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def mark_state(state: DataFrame, change: DataFrame) -> DataFrame:
    """The state table after changes: the last update of each (collector, key) holds."""
    return latest_wins(state.unionByName(change), ["collector", "key"], [F.col("updated_at")])


def state_of(state: DataFrame, collector: str, key: str) -> DataFrame:
    """The one row of a collector's key in the state table, or none."""
    return state.where((F.col("collector") == collector) & (F.col("key") == key))


def parsed_trades(raw: DataFrame, column: str = "value") -> DataFrame:
    """Trades from messages ``{"channel": "trades", "data": [...]}``; other channels and malformed rows are left out."""
    item = "array<struct<time:bigint,coin:string,tid:bigint,side:string,px:string,sz:string>>"
    message = F.from_json(F.col(column), f"channel string, data {item}")
    rows = raw.select(message.alias("m")).where("m.channel = 'trades'").select(F.explode("m.data").alias("t"))
    rows = rows.select(F.timestamp_millis("t.time").alias("ts"), F.col("t.coin").alias("coin"), F.col("t.tid").alias("trade_id"), F.col("t.side").alias("side"), F.expr("try_cast(t.px as double)").alias("price"), F.expr("try_cast(t.sz as double)").alias("size"))
    return rows.where("ts is not null and coin is not null and side in ('A', 'B') and price is not null and size is not null")


def parsed_funding(raw: DataFrame, at: Column, column: str = "value") -> DataFrame:
    """Hourly funding from ``[{"universe": [...]}, [...]]``: both lists are matched by place."""
    names = F.from_json(F.get_json_object(column, "$[0].universe"), "array<struct<name:string>>")
    values = F.from_json(F.get_json_object(column, "$[1]"), "array<struct<funding:string,premium:string,openInterest:string,markPx:string,oraclePx:string>>")
    rows = raw.select(F.date_trunc("hour", at).alias("ts"), F.explode(F.arrays_zip(names.alias("u"), values.alias("v"))).alias("x"))
    number = lambda f: F.expr(f"try_cast(x.v.{f} as double)")
    return rows.select("ts", F.col("x.u.name").alias("coin"), number("funding").alias("funding_rate"), number("premium").alias("premium"), number("openInterest").alias("open_interest"), number("markPx").alias("mark_price"), number("oraclePx").alias("oracle_price")).where("coin is not null and funding_rate is not null")


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def latest_file(spark: SparkSession, path: str, stem: str, ending: str) -> str | None:
    """The file ``stem``<number>``ending`` of the greatest number (10 after 9) below a path of any store, null if there is none.

    Names are listed by Spark's own file index; contents are not read.
    """
    if not exists(spark, path):
        return None
    number = F.regexp_extract("path", rf"/\Q{stem}\E(\d+)\Q{ending}\E$", 1)
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"{stem}*{ending}").load(path).select("path").where(number != "")
    # Numbers of any length: the longer one without leading zeros is the greater.
    digits = F.ltrim(number, F.lit("0"))
    return names.agg(F.max_by("path", F.struct(F.length(digits), digits, "path"))).first()[0]
