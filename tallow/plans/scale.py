"""Registered queries of what has to work at any size: scans over pieces, selection, merges, catalog tables, resumed loads, state over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.functions.windows import ordered
from tallow.operators import drawdown, profile, quantiles, warehouse
from tallow.plans.registry import SQL, add
from tallow.plans.runner import Run, Step, StepFailed, input_version
from tallow.sources.bars import bars_1d, bars_1h, silver, table
from tallow.sources.merge import MergeTable
from tallow.sources.sinks import markdown_lines
from tallow.sources.stages import scratch_path
from tallow.sources.tables import create_table, drop_table
from tallow.streaming import drain, drain_counted, without_duplicates
from tallow.streaming.series import ROCKS, stream_indicators

_KEYS = ("asset_symbol", "interval")


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("volume"), 4).alias("volume"), F.min("date").alias("first_date"))


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by month; the last month is revised, twice the same: one partition is rewritten, once."""
    bars = bars_1d(spark, sf_dir).withColumn("month", F.date_format("date", "yyyy-MM"))
    t = MergeTable(spark, scratch_path(spark, "merge"), ("asset_symbol", "interval", "date", "month"), ("month",))
    t.merge(bars)
    before = t.manifest()["parts"]
    last = t.read().agg(F.max("month")).first()[0]
    revised = t.read().where(F.col("month") == last).withColumn("volume", F.col("volume") + 1)
    t.merge(revised)
    version = t.merge(revised)
    after = t.manifest()["parts"]
    kept = sum(after[p] == f for p, f in before.items())
    return _sums(t.read(), "asset_symbol").withColumns({"kept": F.lit(kept), "rewritten": F.lit(len(after) - kept), "version": F.lit(version)})


add(
    "load_merge",
    _merge,
    """WITH m AS (SELECT *, strftime(date, '%Y-%m') AS month FROM bars_1d), l AS (SELECT max(month) AS last, count(DISTINCT month) AS months FROM m)
    SELECT asset_symbol, count(*) AS n, round(sum(volume + (month = last)::INT), 4) AS volume, min(date) AS first_date, any_value(months) - 1 AS kept, 1 AS rewritten, 2 AS version FROM m, l GROUP BY 1""",
)


def _stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles in two loads; the stream is started again between them, and goes on from its state."""
    path, b = scratch_path(spark, "candles"), bars_1h(spark, sf_dir)
    mid = F.lit("2024-01-16").cast("timestamp_ntz")
    old = {k: spark.conf.get(k, None) for k in ROCKS}
    try:
        for k, v in ROCKS.items():
            spark.conf.set(k, v)
        for part in (b.where(F.col("date") < mid), b.where(F.col("date") >= mid)):
            part.write.mode("append").parquet(f"{path}/in")
            candles = spark.readStream.schema(b.schema).parquet(f"{path}/in")
            out = drain(stream_indicators(candles), f"{path}/out")
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return out.select("asset_symbol", "date", *[F.round(c, 6).alias(c) for c in ("rsi_14", "ema_12", "ema_26", "macd", "macd_signal", "atr_14")])


def _dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come three times, in three batches; by the third the older half are behind the watermark."""
    path, e = scratch_path(spark, "thrice"), table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("asset_symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")
    for _ in range(3):
        e.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out, counts = drain_counted(without_duplicates(stream, ["event_id"], "15 days"), f"{path}/out")
    return out.groupBy("asset_symbol").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).withColumns({"late": F.lit(counts["late"]).cast("long")})


add("stream_dedup", _dedup_stream, "WITH m AS (SELECT count(*) AS late FROM events, (SELECT max(date_trunc('millisecond', ts)) AS m FROM events) WHERE ts <= m - INTERVAL 15 DAY) SELECT event_type AS asset_symbol, count(*) AS n, round(sum(value), 4) AS value, any_value(late) AS late FROM events, m GROUP BY 1")

_P = (0.01, 0.25, 0.5, 0.9, 0.99)
add(
    "quantiles_exact",
    lambda s, d: quantiles.exact_quantiles(silver(s, d), ["close", "volume"], _P, _KEYS).withColumn("quantile", F.round("quantile", 6)),
    "WITH p AS (SELECT unnest([" + ", ".join(f"{p}::DOUBLE" for p in _P) + "]) AS p, unnest(range(1, 6)) AS i), u AS (SELECT asset_symbol, interval, feature, quantile_cont(x, [" + ", ".join(map(str, _P)) + "]) AS q FROM (UNPIVOT (SELECT asset_symbol, interval, close, volume FROM silver) ON close, volume INTO NAME feature VALUE x) GROUP BY ALL) SELECT asset_symbol, interval, feature, p, round(q[i], 6) AS quantile FROM u, p",
)
add(
    "profile_islands",
    lambda s, d: profile.islands(bars_1h(s, d), 3600).withColumn("island", F.col("island").cast("long")),
    """WITH b AS (SELECT asset_symbol, interval, date, coalesce(epoch(date) - epoch(lag(date) OVER (PARTITION BY asset_symbol ORDER BY date)) > 3600, true)::INT AS new FROM bars_1h), i AS (SELECT *, sum(new) OVER (PARTITION BY asset_symbol ORDER BY date)::BIGINT AS island FROM b),
    g AS (SELECT asset_symbol, interval, island, min(date) AS first_date, max(date) AS last_date, count(*) AS candles FROM i GROUP BY ALL) SELECT *, (epoch(lead(first_date) OVER (PARTITION BY asset_symbol ORDER BY island)) - epoch(last_date))::BIGINT AS gap_seconds FROM g""",
)


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold as a bucketed table: built, opened by name, and read by a window that needs no exchange."""
    name = "tallow_bars_bucketed"
    drop_table(spark, name)
    create_table(silver(spark, sf_dir), name, _KEYS, ("date",), if_not_exists=True)
    t = spark.table(name)
    return t.select("asset_symbol", "interval", "date", F.round(F.avg("close").over(ordered().rowsBetween(-6, 0)), 6).alias("sma_7"))


add("catalog_bucketed", _catalog, "SELECT asset_symbol, interval, date, round(avg(close) OVER (PARTITION BY asset_symbol, interval ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS sma_7 FROM silver")


def load_steps(sf_dir: str, stop: list[str]) -> list[Step]:
    """The loads from event tables to gold; steps named in `stop` fail once."""

    def gold(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        if "gold" in stop:
            stop.remove("gold")
            raise OSError("the store is away")
        return warehouse.gold(t["facts"], t["assets"], warehouse.dim_interval(spark))

    def facts(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        return warehouse.with_price_ids(warehouse.load_facts(t["clean"], t["assets"], warehouse.calendar_of(t["clean"]), warehouse.dim_interval(spark)))

    return [
        Step("bronze", lambda s, t: silver(s, sf_dir)),
        Step("clean", lambda s, t: warehouse.dedup(warehouse.clean(t["bronze"])), ("bronze",), retries=1),
        Step("assets", lambda s, t: warehouse.dim_assets(t["clean"]), ("clean",)),
        Step("facts", facts, ("clean", "assets")),
        Step("gold", gold, ("facts", "assets")),
    ]


def _resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose last step fails, its resumption, and a run with nothing to do."""
    path, stop = scratch_path(spark, "run"), ["gold"]
    run = Run(spark, path, load_steps(sf_dir, stop))
    inputs = {t: input_version(spark, f"{sf_dir}/{t}.parquet") for t in ("lineitem", "events")}
    try:
        run.run(inputs)
        failed = "none"
    except StepFailed as e:
        failed = str(e).split(":")[0]
    resumed, again = run.run(inputs), run.run(inputs)
    return _sums(run.table("gold"), *_KEYS).withColumns({"failed": F.lit(failed), "resumed": F.lit(",".join(resumed)), "again": F.lit(len(again))})


add("load_resumed", _resumed, "SELECT asset_symbol, interval, count(*) AS n, round(sum(volume), 4) AS volume, min(date) AS first_date, 'gold' AS failed, 'gold' AS resumed, 0 AS again FROM silver WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 GROUP BY ALL")


def _facts_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the stocks, then of all, with running keys and the times of their load."""
    b = warehouse.clean(silver(spark, sf_dir))
    assets, dates, intervals = warehouse.dim_assets(b), warehouse.calendar_of(b), warehouse.dim_interval(spark)
    have = warehouse.with_audit(warehouse.with_price_ids(warehouse.load_facts(b.where("asset_class = 'Stock'"), assets, dates, intervals)))
    fresh = warehouse.with_audit(warehouse.with_price_ids(warehouse.load_facts(b, assets, dates, intervals, have), have))
    return have.unionByName(fresh).where("created_at IS NOT NULL AND updated_at >= created_at").select("price_id", "asset_id", F.col("interval_id").cast("long").alias("interval_id"), "timestamp", F.round("close", 8).alias("close"))


add(
    "facts_numbered",
    _facts_numbered,
    """WITH k AS (SELECT * FROM silver WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0), a AS (SELECT asset_symbol, row_number() OVER (ORDER BY asset_symbol) AS asset_id FROM (SELECT DISTINCT asset_symbol FROM k)),
    f AS (SELECT asset_class, asset_id, CASE interval WHEN '1h' THEN 1 WHEN '1d' THEN 3 ELSE 5 END::BIGINT AS interval_id, date AS timestamp, round(close, 8) AS close FROM k JOIN a USING (asset_symbol))
    SELECT row_number() OVER (ORDER BY asset_class DESC, asset_id, interval_id, timestamp) AS price_id, asset_id, interval_id, timestamp, close FROM f""",
)

_INDEX = """r AS (SELECT asset_symbol, interval, date, ln(close / lag(close) OVER (PARTITION BY asset_symbol, interval ORDER BY date)) AS r FROM silver), i AS (SELECT interval, date, count(*) AS assets, avg(r) AS log_return FROM r WHERE r IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(log_return) OVER (PARTITION BY interval ORDER BY date) AS cumulative FROM i), p AS (SELECT *, greatest(max(cumulative) OVER (PARTITION BY interval ORDER BY date), 0) AS peak FROM c)"""
add(
    "drawdown_index",
    lambda s, d: drawdown.market_index(silver(s, d)).select("interval", "date", "assets", *[F.round(c, 6).alias(c) for c in ("log_return", "cumulative", "peak", "drawdown")]),
    f"WITH {_INDEX} SELECT interval, date, assets, round(log_return, 6) AS log_return, round(cumulative, 6) AS cumulative, round(peak, 6) AS peak, round(exp(cumulative - peak) - 1, 6) AS drawdown FROM p",
)
add(
    "drawdown_assets",
    lambda s, d: drawdown.drawdowns(silver(s, d)).groupBy(*_KEYS).agg(F.round(F.min("drawdown"), 8).alias("max_drawdown"), F.round(F.max("peak"), 8).alias("peak")),
    "WITH p AS (SELECT *, max(close) OVER (PARTITION BY asset_symbol, interval ORDER BY date) AS peak FROM silver) SELECT asset_symbol, interval, round(min(close / peak - 1), 8) AS max_drawdown, round(max(peak), 8) AS peak FROM p GROUP BY ALL",
)


def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that are stored three times, with other volumes: of each key the largest volume stays."""
    b = bars_1h(spark, sf_dir)
    more = [b.withColumn("volume", F.col("volume") + F.hour("date") % k).withColumn("close", F.col("close") + k) for k in (2, 3)]
    return warehouse.dedup(b.unionByName(more[0]).unionByName(more[1])).select("asset_symbol", "date", F.round("close", 6).alias("close"), "volume")


add(
    "dedup_max_volume",
    _dedup,
    "WITH u AS (SELECT * FROM bars_1h UNION ALL SELECT * REPLACE (volume + hour(date) % 2 AS volume, close + 2 AS close) FROM bars_1h UNION ALL SELECT * REPLACE (volume + hour(date) % 3 AS volume, close + 3 AS close) FROM bars_1h) SELECT asset_symbol, date, round(close, 6) AS close, volume FROM u QUALIFY row_number() OVER (PARTITION BY asset_symbol, date ORDER BY volume DESC, close DESC) = 1",
)
add("profile_latest", lambda s, d: profile.latest(silver(s, d), 20).select(*_KEYS, "date", F.round("close", 8).alias("close"), "volume"), "SELECT asset_symbol, interval, date, round(close, 8) AS close, volume FROM silver QUALIFY row_number() OVER (PARTITION BY asset_symbol, interval ORDER BY date DESC) <= 20")
# What the stream gives is what indicators_recursive has, over hourly bars.
add("stream_indicators", _stream_state)
SQL["stream_indicators"] = SQL["indicators_recursive"].replace("FROM bars_1d)", "FROM bars_1h)")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profilers' report: what there is, and which series stand still."""
    b = silver(spark, sf_dir)
    volume = profile.data_volume(b).select(*_KEYS, "total_rows")
    dead = profile.dead_assets(b).select(*_KEYS, "dead")
    return markdown_lines(volume, "Data volume", _KEYS).unionByName(markdown_lines(dead, "Frozen prices", _KEYS))


add(
    "report_market",
    _report,
    """WITH v AS (SELECT asset_symbol, interval, count(*) AS n FROM silver GROUP BY ALL), l AS (SELECT * FROM silver QUALIFY row_number() OVER (PARTITION BY asset_symbol, interval ORDER BY date DESC) <= 7),
    d AS (SELECT asset_symbol, interval, CASE WHEN count(*) = 7 AND count(DISTINCT close) = 1 THEN 'true' ELSE 'false' END AS dead FROM l GROUP BY ALL)
    SELECT * FROM (VALUES ('Data volume', 1, '## Data volume'), ('Data volume', 2, '| asset_symbol | interval | total_rows |'), ('Data volume', 3, '|---|---|---|'), ('Frozen prices', 1, '## Frozen prices'), ('Frozen prices', 2, '| asset_symbol | interval | dead |'), ('Frozen prices', 3, '|---|---|---|')) t(section, line_no, line)
    UNION ALL SELECT 'Data volume', row_number() OVER (ORDER BY asset_symbol, interval) + 3, '| ' || asset_symbol || ' | ' || interval || ' | ' || n || ' |' FROM v
    UNION ALL SELECT 'Frozen prices', row_number() OVER (ORDER BY asset_symbol, interval) + 3, '| ' || asset_symbol || ' | ' || interval || ' | ' || dead || ' |' FROM d""",
)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols padded, cut and formatted."""
    b = silver(spark, sf_dir).groupBy(*_KEYS).agg(F.count("*").alias("n"), F.round(F.avg("close"), 2).alias("mean"))
    wide = F.rpad("asset_symbol", 12, " ")
    return b.select(*_KEYS, F.rtrim(wide).alias("trimmed"), F.length(wide).cast("long").alias("width"), F.upper(F.concat_ws("/", *_KEYS)).alias("label"), F.format_string("%s: %d rows", F.rtrim(wide), "n").alias("said"), F.substring("asset_symbol", 1, 3).alias("short"))


add(
    "sql_strings",
    _labels,
    "WITH b AS (SELECT asset_symbol, interval, count(*) AS n, rpad(asset_symbol, 12, ' ') AS w FROM silver GROUP BY ALL) SELECT asset_symbol, interval, rtrim(w) AS trimmed, length(w) AS width, upper(asset_symbol || '/' || interval) AS label, printf('%s: %d rows', rtrim(w), n) AS said, asset_symbol[1:3] AS short FROM b",
)
