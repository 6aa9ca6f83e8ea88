"""Candles: explicit schemas, tagged scans, builders over event tables, kline JSON, sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OHLCV = ["open", "high", "low", "close", "volume"]
CRYPTO_EXTRAS = ["turnover", "open_interest", "funding_rate"]
BAR_SCHEMA = T.StructType([T.StructField("date", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in OHLCV]])
# Interval codes of the exchange API.
INTERVAL_CODES = {"60": "1h", "240": "4h", "D": "1d", "W": "W", "M": "M"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_nan(df: DataFrame, *cols: str) -> DataFrame:
    """NaN to NULL, so that one kind of missing value remains."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def scan_tagged(spark: SparkSession, files: Iterable[tuple[str, str, str]], schema: T.StructType = BAR_SCHEMA) -> DataFrame:
    """Union of (path, symbol, interval) scans with the tags as columns; a path that is not there is skipped."""
    out = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("symbol", T.StringType()), T.StructField("interval", T.StringType())]))
    for path, symbol, interval in files:
        if exists(spark, path):
            out = out.unionByName(spark.read.schema(schema).parquet(path).withColumns({"symbol": F.lit(symbol), "interval": F.lit(interval)}), allowMissingColumns=True)
    return out


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[{"datetime": "date"}.get(n := c.strip().lower().replace(" ", "_"), n) for c in df.columns])


def parse_klines(pages: DataFrame, col: str = "body") -> DataFrame:
    """Kline pages ({result: {list: [[ms, o, h, l, c, v, turnover], ...]}}) to bars; unreadable numbers become NULL."""
    rows = pages.select(F.explode(F.from_json(col, "result struct<list: array<array<string>>>")["result"]["list"]).alias("k"))
    number = lambda i: F.col("k")[i].try_cast("double")
    return rows.select(F.timestamp_millis(F.col("k")[0].try_cast("long")).cast("timestamp_ntz").alias("date"), *[number(i + 1).alias(c) for i, c in enumerate([*OHLCV, "turnover"])])


def _candles(df: DataFrame, keys: list[str], price: F.Column, order: F.Column, volume: F.Column, turnover: F.Column, interval: str) -> DataFrame:
    order = F.when(price.isNotNull(), order)  # open and close are the first and last known prices
    return df.groupBy(*keys, F.lit(interval).alias("interval")).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), volume.cast("double").alias("volume"), turnover.alias("turnover"))


def bars_1d(spark: SparkSession, sf_dir: str, interval: str = "1d") -> DataFrame:
    date = F.col("l_shipdate") if interval == "1d" else F.date_trunc("week", "l_shipdate").cast("timestamp_ntz")
    li = table(spark, sf_dir, "lineitem").withColumns({"asset_symbol": F.col("l_returnflag"), "date": date})
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return _candles(li, ["asset_symbol", "date"], F.col("l_extendedprice") / F.col("l_quantity"), order, F.sum("l_quantity"), F.round(F.sum("l_extendedprice"), 2), interval)


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumns({"asset_symbol": F.col("event_type"), "date": F.date_trunc("hour", "ts").cast("timestamp_ntz")})
    return _candles(ev, ["asset_symbol", "date"], F.col("value"), F.col("ts"), F.count("*"), F.round(F.sum("value"), 2), "1h")


def bars_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumns({"asset_symbol": F.col("o_orderpriority"), "date": F.col("o_orderdate")})
    return _candles(o, ["asset_symbol", "date"], F.col("o_totalprice"), F.col("o_orderkey"), F.count("*"), F.round(F.sum("o_totalprice"), 2), "1d")


def crypto_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open interest (users of the hour) and funding (printed every eighth hour) of the hourly series."""
    ev = table(spark, sf_dir, "events").withColumns({"asset_symbol": F.col("event_type"), "date": F.date_trunc("hour", "ts").cast("timestamp_ntz")})
    rate = F.when(F.hour("date") % 8 == 0, F.avg("value") / 1000)
    return ev.groupBy("asset_symbol", F.lit("1h").alias("interval"), "date").agg(F.count_distinct("user_id").cast("double").alias("open_interest"), rate.alias("funding_rate"))


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of two classes and three intervals in one table: daily and weekly stocks, hourly crypto with its extras. Key: symbol, interval, date."""
    stocks = bars_1d(spark, sf_dir).unionByName(bars_1d(spark, sf_dir, "1wk")).drop("turnover").withColumns({"asset_class": F.lit("Stock"), "exchange": F.lit("NYSE")})
    crypto = bars_1h(spark, sf_dir).join(crypto_extras(spark, sf_dir), ["asset_symbol", "interval", "date"], "left").withColumns({"asset_class": F.lit("Crypto"), "exchange": F.lit("Bybit")})
    return stocks.unionByName(crypto, allowMissingColumns=True)


_LINES = "SELECT l_returnflag AS asset_symbol, '{}' AS interval, {} AS date, min_by(p, k) AS open, max(p) AS high, min(p) AS low, max_by(p, k) AS close, sum(l_quantity)::DOUBLE AS volume, round(sum(l_extendedprice), 2) AS turnover FROM (SELECT *, l_extendedprice / l_quantity AS p, {{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey}} AS k FROM lineitem) GROUP BY ALL"
BARS_SQL = f"""
bars_1d AS ({_LINES.format("1d", "l_shipdate")}
), bars_1wk AS ({_LINES.format("1wk", "date_trunc('week', l_shipdate)::TIMESTAMP")}
), bars_1h AS (
  SELECT event_type AS asset_symbol, '1h' AS interval, date_trunc('hour', ts) AS date, min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close, count(*)::DOUBLE AS volume, round(sum(value), 2) AS turnover
  FROM events GROUP BY ALL
), bars_ord AS (
  SELECT o_orderpriority AS asset_symbol, '1d' AS interval, o_orderdate AS date, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume, round(sum(o_totalprice), 2) AS turnover
  FROM orders GROUP BY ALL
), extras AS (
  SELECT asset_symbol, date, count(DISTINCT user_id)::DOUBLE AS open_interest, CASE WHEN hour(date) % 8 = 0 THEN avg(value) / 1000 END AS funding_rate FROM (SELECT event_type AS asset_symbol, date_trunc('hour', ts) AS date, user_id, value FROM events) GROUP BY asset_symbol, date
), silver AS (
  SELECT asset_symbol, 'Stock' AS asset_class, 'NYSE' AS exchange, interval, date, open, high, low, close, volume, NULL::DOUBLE AS turnover, NULL::DOUBLE AS open_interest, NULL::DOUBLE AS funding_rate
  FROM (SELECT * FROM bars_1d UNION ALL SELECT * FROM bars_1wk)
  UNION ALL SELECT asset_symbol, 'Crypto', 'Bybit', interval, date, open, high, low, close, volume, turnover, open_interest, funding_rate FROM bars_1h LEFT JOIN extras USING (asset_symbol, date)
)"""
