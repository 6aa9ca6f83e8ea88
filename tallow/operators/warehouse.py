"""Silver, star schema and gold: cleaning, de-duplication, upserts, dimensions, incremental facts, moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallow.functions.windows import BY
from tallow.operators.series import meet, numbered
from tallow.sources.stages import stage

# Interval code, minutes, description; the id is the place.
INTERVALS = [("1h", 60, "Hourly"), ("60", 60, "Hourly (Bybit)"), ("1d", 1440, "Daily"), ("D", 1440, "Daily (Bybit)"), ("1wk", 10080, "Weekly"), ("W", 10080, "Weekly (Bybit)"), ("1mo", 43200, "Monthly"), ("M", 43200, "Monthly (Bybit)"), ("4h", 240, "4-Hour"), ("240", 240, "4-Hour (Bybit)")]
DATE_FROM, YEARS_AHEAD = "1992-01-01", 5


def clean(bars: DataFrame) -> DataFrame:
    """Positive prices, non-negative volume, known date."""
    positive = [F.col(c) > 0 for c in ("open", "high", "low", "close")]
    return bars.where(positive[0] & positive[1] & positive[2] & positive[3] & (F.col("volume") >= 0) & F.col("date").isNotNull())


def dedup(bars: DataFrame, keys: tuple[str, ...] = ("asset_symbol", "interval", "date")) -> DataFrame:
    """One row per key: the largest volume; ties by the whole row, so that reruns agree."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("volume"), *[F.desc_nulls_last(c) for c in bars.columns if c not in (*keys, "volume")])
    return bars.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """old and new with the new row where both have a key; columns are matched by name."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), *[F.desc_nulls_last(c) for c in old.columns if c not in keys])
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def with_audit(df: DataFrame) -> DataFrame:
    """created_at and updated_at: the time of the load; a row that has a created_at keeps it."""
    now = F.current_timestamp().cast("timestamp_ntz")
    created = F.coalesce(F.col("created_at"), now) if "created_at" in df.columns else now
    return df.withColumns({"created_at": created, "updated_at": now})


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def first_of_key(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row per key, the first by `order` (keep first)."""
    w = Window.partitionBy(*keys).orderBy(*order, *[c for c in df.columns if c not in (*keys, *order)])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dim_date(spark: SparkSession, first: str = DATE_FROM, last: str | None = None) -> DataFrame:
    """One row per day up to `last`, else some years ahead of today."""
    upto = f"DATE '{last}'" if last else f"add_months(current_date(), {12 * YEARS_AHEAD})"
    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', {upto}, INTERVAL 1 DAY)) AS date")
    dow = F.dayofweek("date") - 1
    return days.select(
        (F.datediff("date", F.lit(first).cast("date")) + 1).cast("long").alias("date_id"), "date", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month"), F.date_format("date", "MMMM").alias("month_name"),
        F.weekofyear("date").alias("week"), dow.alias("day_of_week"), F.date_format("date", "EEEE").alias("day_name"), dow.between(1, 5).alias("is_business_day"), dow.isin(0, 6).alias("is_weekend"),
    )


def dim_interval(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, *x) for i, x in enumerate(INTERVALS)], "interval_id int, interval_code string, interval_minutes int, interval_description string")


def dim_assets(bars: DataFrame, asset_class: str = "Stock", exchange: str = "unknown", have: DataFrame | None = None) -> DataFrame:
    """Surrogate keys over the distinct symbols (a dimension: one row per asset); USDT is cut from symbols.

    With `have`, its rows stay and new symbols follow its largest id. Class and exchange are those of the bars, where they have such columns.
    """
    kind = [F.min(c).alias(c) if c in bars.columns else F.lit(x).alias(c) for c, x in (("asset_class", asset_class), ("exchange", exchange))]
    symbols = bars.groupBy(F.replace("asset_symbol", F.lit("USDT"), F.lit("")).alias("asset_symbol")).agg(*kind) if any(c in bars.columns for c in ("asset_class", "exchange")) else bars.select(F.replace("asset_symbol", F.lit("USDT"), F.lit("")).alias("asset_symbol")).distinct().select("asset_symbol", *kind)
    if have is not None:
        symbols = symbols.join(have.select("asset_symbol"), "asset_symbol", "left_anti").crossJoin(have.agg(F.coalesce(F.max("asset_id"), F.lit(0)).alias("_last")))
    ids = F.row_number().over(Window.orderBy("asset_symbol")).cast("long")
    out = symbols.select((ids if have is None else ids + F.col("_last")).alias("asset_id"), "asset_symbol", "asset_class", "exchange")
    return out if have is None else have.unionByName(out)


def load_facts(bars: DataFrame, assets: DataFrame, dates: DataFrame, intervals: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """New facts: bars (by symbol, interval and date) joined to the dimensions, less those already loaded. Dates and intervals are bounded by the calendar and broadcast; assets as Spark sees fit."""
    b = bars.withColumns({"asset_symbol": F.replace("asset_symbol", F.lit("USDT"), F.lit("")), "_day": F.col("date").cast("date"), "interval_code": F.col("interval")})
    f = b.join(assets.select("asset_id", "asset_symbol"), "asset_symbol")
    f = f.join(F.broadcast(dates.select("date_id", F.col("date").alias("_day"))), "_day").join(F.broadcast(intervals.select("interval_id", "interval_code")), "interval_code")
    f = f.select("asset_id", "date_id", "interval_id", F.col("date").alias("timestamp"), "open", "high", "low", "close", "volume", (F.col("high") - F.col("low")).alias("daily_volatility"))
    return f if have is None else f.join(have.select("asset_id", "interval_id", "timestamp"), ["asset_id", "interval_id", "timestamp"], "left_anti").select(*f.columns)


def with_price_ids(facts: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """facts with price_id, 1, 2, ... by asset, interval and time; after the largest of `have`, if given. Ids are prefix sums of the counts of ranges, so no task sees all facts."""
    last = have.agg(F.coalesce(F.max("price_id"), F.lit(0))).first()[0] if have is not None else 0
    n = numbered(facts.withColumn("_all", F.lit(0)), ("_all",), ("asset_id", "interval_id", "timestamp"))
    return n.select((F.col("row_no") + last).alias("price_id"), *facts.columns)


def calendar_of(bars: DataFrame, years_ahead: int = YEARS_AHEAD) -> DataFrame:
    """dim_date from the bars' own first day to some years after their last: no fact falls outside it."""
    first, last = bars.agg(F.min("date").cast("date"), F.max("date").cast("date")).first()
    return dim_date(bars.sparkSession, str(first or DATE_FROM), str((last or first).replace(month=12, day=28).replace(year=last.year + years_ahead)) if last else None)


def gold(facts: DataFrame, assets: DataFrame, intervals: DataFrame) -> DataFrame:
    """Denormalised facts with 7- and 30-row moving averages (partial windows count)."""
    g = facts.join(assets, "asset_id").join(F.broadcast(intervals.select("interval_id", "interval_code")), "interval_id")
    w = Window.partitionBy("asset_symbol", "interval").orderBy("date")
    g = g.withColumnsRenamed({"interval_code": "interval", "timestamp": "date"})
    return g.select(
        "asset_symbol", "asset_class", "exchange", "interval", "date", "open", "high", "low", "close", "volume", "daily_volatility",
        F.avg("close").over(w.rowsBetween(-6, 0)).alias("sma_7"), F.avg("close").over(w.rowsBetween(-29, 0)).alias("sma_30"),
    )


def high_water_mark(bars: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    return bars.groupBy(*by).agg(F.max("date").alias("last_date"))


def macro_table(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """Three (date, close) series aligned in time. The third meets the first by date only, so a date that is in the second and third alone gives two rows."""
    first = a.select(F.col("date").alias("d1"), F.col("close").alias("dxy_close")).join(b.select(F.col("date").alias("d2"), F.col("close").alias("vix_close")), F.col("d1") == F.col("d2"), "full_outer")
    both = first.join(c.select(F.col("date").alias("d3"), F.col("close").alias("tnx_close")), F.col("d1") == F.col("d3"), "full_outer")
    return both.select(F.coalesce("d1", "d2", "d3").alias("date"), "dxy_close", "vix_close", "tnx_close")


BUCKET_ROWS = 65_536


def bucket_width(rows: DataFrame, per_bucket: int = BUCKET_ROWS) -> int:
    """Microseconds of time buckets that hold about per_bucket rows."""
    one = rows.agg(F.min(_micros()).alias("a"), F.max(_micros()).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return max(1, ((one["b"] or 0) - (one["a"] or 0) + 1) * per_bucket // max(one["n"], 1))


def _micros(col: str = "date") -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def carry_forward(rows: DataFrame, col: str, by: tuple[str, ...], order: tuple[str, ...] = ("date",), width: int | None = None) -> DataFrame:
    """rows with col's nulls filled by the last known value before, in `order` (which begins with date) within by.

    A task sees a bucket of time, not a series: each bucket's last known value is found by an aggregate, a pass over the buckets (a row
    each) carries it on, over empty ones too, and rows before a bucket's first known value take what is carried in.
    """
    width = width or bucket_width(rows)
    b = rows.withColumn("_bucket", F.floor(_micros() / width))
    known = F.col(col).isNotNull()
    last = F.max_by(F.when(known, F.col(col)), F.when(known, F.struct(*order)))
    buckets = b.groupBy(*by, "_bucket").agg(last.alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = stage(buckets.select(*by, "_bucket", carried.alias("_carried")), "carried")
    inner = F.last(col, ignorenulls=True).over(Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return meet(b.withColumn(col, inner), carried, (*by, "_bucket")).withColumn(col, F.coalesce(col, "_carried")).drop("_bucket", "_carried")


def align_exact_ffill(bars: DataFrame, aux: DataFrame, col: str, by: tuple[str, ...] = BY, width: int | None = None) -> DataFrame:
    """aux (by, date, col) on bars: exact time match, then carried forward."""
    return carry_forward(bars.join(aux.select(*by, "date", col), [*by, "date"], "left"), col, by, width=width)


def align_asof(bars: DataFrame, aux: DataFrame, col: str, by: tuple[str, ...] = ("asset_symbol",), width: int | None = None) -> DataFrame:
    """aux on bars: the last print at or before each bar, by a union that is carried forward, never a range join."""
    both = bars.withColumn("_side", F.lit(1)).unionByName(aux.select(*by, "date", col).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    return carry_forward(both, col, by, ("date", "_side"), width).where("_side = 1").drop("_side")
