"""Registered loads, sinks and streams: each writes, reads back and returns what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallow.functions.windows import ordered
from tallow.operators import modelling, warehouse
from tallow.plans.registry import add
from tallow.sources import bars as sources
from tallow.sources import sinks
from tallow.sources.bars import bars_1d, bars_1h, silver
from tallow.streaming import drain, event_stream, stream_candles

_SUMS = "count(*) AS n, round(sum(volume), 4) AS volume, min(date) AS first_date"


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("volume"), 4).alias("volume"), F.min("date").alias("first_date"))


def _partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.scratch_path(spark, "silver")
    sinks.write_partitioned(silver(spark, sf_dir), path, ("asset_class", "interval"))
    return _sums(spark.read.parquet(path), "asset_class", "interval", "asset_symbol")


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.scratch_path(spark, "report")
    report = _sums(silver(spark, sf_dir), "asset_symbol", "interval")
    sinks.write_json(report, path)
    return spark.read.schema(report.schema).json(path)


def _tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.scratch_path(spark, "tensors")
    modelling.sequences(modelling.targets(bars_1d(spark, sf_dir)), ["open", "close"], 20).write.parquet(path)
    steps = spark.read.parquet(path).select("asset_symbol", F.posexplode("x").alias("step", "v"))
    return steps.groupBy("asset_symbol", F.col("step").cast("long").alias("step")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("v")[1]), 4).alias("mean_close"))


def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, b = sinks.scratch_path(spark, "append"), silver(spark, sf_dir)
    sinks.append(b.where("interval = '1d'"), path)
    sinks.append(b.where("interval <> '1d'"), path)
    return _sums(spark.read.schema(b.schema).parquet(path), "asset_symbol", "interval")


def _insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of the stocks, then of all bars, twice: what is there stays as it is."""
    path, b = sinks.scratch_path(spark, "symbols"), silver(spark, sf_dir)
    of = lambda df, load: df.groupBy("asset_symbol", "interval").agg(F.min("date").alias("first_date")).withColumn("load", F.lit(load))
    sinks.append(of(b.where("asset_class = 'Stock'"), 1), path)
    for load in (2, 3):
        sinks.insert_new(of(b, load), path, ("asset_symbol", "interval"))
    return spark.read.parquet(path)


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval dimension with the candles that the bars have of each."""
    n = silver(spark, sf_dir).groupBy(F.col("interval").alias("interval_code")).agg(F.count("*").alias("candles"))
    return warehouse.dim_interval(spark).join(n, "interval_code", "left").withColumn("candles", F.coalesce("candles", F.lit(0)))


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asset dimension of the stocks, then of all: what is there keeps its key."""
    b = silver(spark, sf_dir)
    return warehouse.dim_assets(b, have=warehouse.dim_assets(b.where("asset_class = 'Stock'")))


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars up to noon of each day, then revised and later ones over them."""
    path, b = sinks.scratch_path(spark, "bronze"), bars_1h(spark, sf_dir)
    sinks.append(b.where(F.hour("date") <= 12), path)
    sinks.upsert_into(b.where(F.hour("date") >= 12).withColumn("volume", F.col("volume") + 1), path, ("asset_symbol", "interval", "date"), f"{path}-2")
    return _sums(spark.read.parquet(f"{path}-2"), "asset_symbol")


def _keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_1h(spark, sf_dir)
    twice = b.unionByName(b.withColumn("volume", F.col("volume") + 1))
    return _sums(warehouse.first_of_key(twice, ("asset_symbol", "date"), ("volume",)), "asset_symbol")


def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT asset_symbol, date, close FROM {b} WHERE interval = :interval AND close > :least ORDER BY date", args={"interval": "1wk", "least": 100.0}, b=silver(spark, sf_dir))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per symbol, tagged on reading; one path that does not exist."""
    path, b = sinks.scratch_path(spark, "files"), bars_1h(spark, sf_dir)
    b.write.partitionBy("asset_symbol").parquet(path)
    names = [r[0] for r in b.select("asset_symbol").distinct().collect()]
    found = sources.scan_tagged(spark, [(f"{path}/asset_symbol={n}", n, "1h") for n in [*names, "none"]])
    return _sums(found.withColumnRenamed("symbol", "asset_symbol"), "asset_symbol", "interval")


def _klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = sinks.klines_of(bars_1h(spark, sf_dir))
    return sources.parse_klines(pages).select("date", "open", "high", "low", "close", "volume", "turnover")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(stream_candles(event_stream(spark, f"{sf_dir}/events.parquet")), sinks.scratch_path(spark, "stream"))


def _exact_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, x = bars_1h(spark, sf_dir), sources.crypto_extras(spark, sf_dir).where("funding_rate IS NOT NULL")
    return warehouse.align_exact_ffill(b, x, "funding_rate").select("asset_symbol", "date", F.round("funding_rate", 8).alias("funding_rate"))


def _thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth candle, and which are among the last 300."""
    w = ordered()
    b = silver(spark, sf_dir).withColumns({"rn": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("asset_symbol", "interval"))})
    return b.where((F.col("rn") - 1) % 10 == 0).select("asset_symbol", "interval", "date", "close", (F.col("rn") > F.col("n") - 300).alias("marked"))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the columns asked for, those that are there, and how full they are."""
    b = silver(spark, sf_dir)
    cols = [c for c in ("turnover", "open_interest", "funding_rate", "premium") if c in b.columns]
    return b.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in cols]).unpivot("n", cols, "feature", "known").select("feature", "known", F.round(F.col("known") / F.col("n"), 6).alias("coverage"))


_AGG = f"SELECT {{}}, {_SUMS} FROM {{}} GROUP BY ALL"
add("sink_partitioned", _partitioned, _AGG.format("asset_class, interval, asset_symbol", "silver"))
add("sink_json", _json, _AGG.format("asset_symbol, interval", "silver"))
add("sink_tensors", _tensors, "WITH a AS (SELECT *, row_number() OVER (PARTITION BY asset_symbol ORDER BY date) AS rn, count(*) OVER (PARTITION BY asset_symbol) AS n FROM bars_1d), s AS (SELECT asset_symbol, close, rn, n, unnest(range(0, 20)) AS step FROM a) SELECT asset_symbol, step, count(*) AS n, round(avg(close), 4) AS mean_close FROM s WHERE rn + 20 - step BETWEEN 21 AND n GROUP BY 1, 2")
add("load_append", _append, _AGG.format("asset_symbol, interval", "silver"))
_INTERVALS = ", ".join(f"({i + 1}, '{c}', {m}, '{t}')" for i, (c, m, t) in enumerate(warehouse.INTERVALS))
add("dim_interval", _intervals, f"WITH i AS (SELECT * FROM (VALUES {_INTERVALS}) t(interval_id, interval_code, interval_minutes, interval_description)), n AS (SELECT interval, count(*) AS n FROM silver GROUP BY 1) SELECT i.*, coalesce(n, 0) AS candles FROM i LEFT JOIN n ON interval = interval_code")
add("load_insert_or_ignore", _insert_new, "SELECT asset_symbol, interval, min(date) AS first_date, CASE WHEN any_value(asset_class) = 'Stock' THEN 1 ELSE 2 END AS load FROM silver GROUP BY 1, 2")
add("load_assets", _assets, "WITH a AS (SELECT asset_symbol, min(asset_class) AS asset_class, min(exchange) AS exchange FROM silver GROUP BY 1) SELECT row_number() OVER (ORDER BY asset_class DESC, asset_symbol) AS asset_id, * FROM a")
add("load_upsert", _upsert, "SELECT asset_symbol, count(*) AS n, round(sum(volume + (hour(date) >= 12)::INT), 4) AS volume, min(date) AS first_date FROM bars_1h GROUP BY 1")
add("load_keep_first", _keep_first, _AGG.format("asset_symbol", "bars_1h"))
add("sql_parameters", _parameters, "SELECT asset_symbol, date, close FROM silver WHERE interval = '1wk' AND close > 100.0 ORDER BY date")
add("scan_tagged", _tagged, _AGG.format("asset_symbol, interval", "bars_1h"))
add("scan_klines", _klines, "SELECT date, open, high, low, close, volume, turnover FROM bars_1h")
add("stream_candles", _stream, "WITH m AS (SELECT max(ts) AS m FROM events) SELECT asset_symbol, date, open, high, low, close, volume::BIGINT AS volume FROM bars_1h, m WHERE date + INTERVAL 1 HOUR <= m - INTERVAL 1 HOUR")
add("join_exact_ffill", _exact_ffill, "SELECT asset_symbol, date, round(last_value(funding_rate IGNORE NULLS) OVER (PARTITION BY asset_symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS funding_rate FROM bars_1h LEFT JOIN extras USING (asset_symbol, date)")
add("thinned", _thinned, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY asset_symbol, interval ORDER BY date) AS rn, count(*) OVER (PARTITION BY asset_symbol, interval) AS n FROM silver) SELECT asset_symbol, interval, date, close, rn > n - 300 AS marked FROM r WHERE (rn - 1) % 10 = 0")
add("column_coverage", _coverage, " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS known, round(count({c}) / count(*), 6) AS coverage FROM silver" for c in ("turnover", "open_interest", "funding_rate")))
add("join_lookup", lambda s, d: silver(s, d).groupBy("interval").agg(F.count("*").alias("n")).join(warehouse.dim_interval(s).select(F.col("interval_code").alias("interval"), "interval_minutes"), "interval", "left"), f"WITH i AS (SELECT * FROM (VALUES {_INTERVALS}) t(a, interval, interval_minutes, b)) SELECT interval, count(*) AS n, any_value(interval_minutes) AS interval_minutes FROM silver LEFT JOIN i USING (interval) GROUP BY 1")
