"""Market and data-quality profilers: one windowed job over all assets each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallow.functions.windows import BY, ordered, rolling
from tallow.operators.matrices import pair_sums
from tallow.operators.quantiles import as_columns, exact_quantiles
from tallow.operators.series import meet
from tallow.sources.stages import stage


def latest(df: DataFrame, n: int, by: tuple[str, ...] = BY) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("date"))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def change(bars: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    p = F.lag("close").over(ordered(by))
    return bars.withColumn("change_pct", (F.col("close") - p) / p * 100)


def top_movers(bars: DataFrame, n: int = 10, gainers: bool = True) -> DataFrame:
    c = change(bars).where("change_pct is not null").select("asset_symbol", "date", "close", F.round("change_pct", 6).alias("change_pct"))
    return c.orderBy(F.desc("change_pct") if gainers else F.asc("change_pct"), "asset_symbol", "date").limit(n)


def volatility_scan(bars: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    return change(bars, by).groupBy(*by).agg(F.round(F.stddev_samp("change_pct"), 6).alias("volatility"))


def last_zscore(bars: DataFrame, window: int = 50, least: int = 30, by: tuple[str, ...] = BY) -> DataFrame:
    c = latest(change(bars, by).where("change_pct is not null"), window, by)
    s = c.groupBy(*by).agg(F.count("*").alias("n"), F.avg("change_pct").alias("m"), F.stddev_samp("change_pct").alias("s"), F.max_by("change_pct", "date").alias("x"))
    return s.where(F.col("n") >= least).select(*by, F.round((F.col("x") - F.col("m")) / F.col("s"), 6).alias("zscore"))


def ma_cross(bars: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Where the 50-row mean crossed the 200-row mean on the last row of each group."""
    w = ordered(by)
    m = bars.withColumns({"a": rolling(F.avg, "close", 50, w), "b": rolling(F.avg, "close", 200, w)})
    m = latest(m.withColumns({"pa": F.lag("a").over(w), "pb": F.lag("b").over(w)}), 1, by)
    signal = F.when((F.col("pa") <= F.col("pb")) & (F.col("a") > F.col("b")), "golden").when((F.col("pa") >= F.col("pb")) & (F.col("a") < F.col("b")), "death").otherwise("none")
    return m.select(*by, signal.alias("signal"))


def squeeze(bars: DataFrame, window: int = 20, ratio: float = 0.7, by: tuple[str, ...] = BY) -> DataFrame:
    w = ordered(by)
    s = latest(bars, 50, by).withColumn("sd", rolling(F.stddev_samp, "close", window, w))
    s = latest(s.withColumn("m", rolling(F.avg, "sd", window, w)), 1, by)
    return s.select(*by, F.round(F.try_divide(F.col("sd"), F.col("m")), 6).alias("ratio"), F.coalesce(F.col("sd") / F.col("m") < ratio, F.lit(False)).alias("squeezed"))


def dead_assets(bars: DataFrame, n: int = 7, by: tuple[str, ...] = BY) -> DataFrame:
    """Whether the last n closes of each group are one price."""
    return latest(bars, n, by).groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("close").alias("k")).select(*by, ((F.col("n") == n) & (F.col("k") == 1)).alias("dead"))


def volume_spikes(bars: DataFrame, times: float = 10.0) -> DataFrame:
    m = bars.withColumn("mean", F.avg("volume").over(ordered().rowsBetween(-30, -1)))
    return m.where(F.col("volume") > F.col("mean") * times).select("asset_symbol", "date", "volume", F.round("mean", 6).alias("mean"))


def spread_outliers(bars: DataFrame, n: int = 10) -> DataFrame:
    s = F.round((F.col("high") - F.col("low")) / F.col("close") * 100, 6)
    return bars.select("asset_symbol", "date", s.alias("spread_pct")).orderBy(F.desc("spread_pct"), "asset_symbol", "date").limit(n)


def overnight_gaps(bars: DataFrame, threshold: float = 2.0, n: int = 10) -> DataFrame:
    p = F.lag("close").over(ordered())
    g = bars.select("asset_symbol", "date", F.round((F.col("open") - p) / p * 100, 6).alias("gap_pct")).where(F.abs("gap_pct") > threshold)
    return g.orderBy(F.abs("gap_pct").desc(), "asset_symbol", "date").limit(n)


def anomalies(bars: DataFrame) -> DataFrame:
    return bars.where("close <= 0 OR volume < 0")


def null_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing values per column: one aggregation, then rows."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot("_n", cols, "feature", "null_count").select("feature", "null_count", F.round(F.col("null_count") / F.col("_n") * 100, 6).alias("null_pct"))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, deviation, least, quartiles, largest and missing values of each column; the quartiles are exact (exact_quantiles)."""
    long = df.select(*[F.col(c).cast("double") for c in cols]).unpivot([], cols, "feature_name", "x")
    g = long.groupBy("feature_name").agg(F.count("x").alias("count"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"), F.round(F.min("x"), 6).alias("min"), F.round(F.max("x"), 6).alias("max"), F.count_if(F.col("x").isNull()).alias("null_count"))
    q = as_columns(exact_quantiles(df, cols, (0.25, 0.5, 0.75)), {0.25: "q25", 0.5: "q50", 0.75: "q75"}).withColumnRenamed("feature", "feature_name")
    g = g.join(q, "feature_name", "left")
    return g.select("feature_name", "count", "mean", "std", "min", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "max", "null_count")


# Minutes of an interval code; any other code counts as a day.
STEP_MINUTES = {"1h": 60, "1d": 1440, "1wk": 10080, "60": 60, "D": 1440, "W": 10080}
# Calendars of the gap scan by interval code; any other code is daily.
CALENDARS = {"1h": "hour", "60": "hour", "1wk": "week", "W": "week", "1mo": "month end", "M": "month end"}


def by_code(codes: dict[str, object], default: object, col: str = "interval") -> Column:
    """A lookup over a fixed map of codes."""
    out = F.lit(None)
    for k, v in codes.items():
        out = F.when(F.col(col) == k, F.lit(v)).otherwise(out)
    return F.coalesce(out, F.lit(default))


def timeline(bars: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Expected against actual candles of each group, where some are missing. The step is that of the interval code."""
    g = bars.groupBy(*by).agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count("*").alias("actual"))
    minutes = (F.unix_seconds(F.col("b").cast("timestamp")) - F.unix_seconds(F.col("a").cast("timestamp"))) / 60
    expected = minutes / by_code(STEP_MINUTES, 1440) + 1
    g = g.withColumn("e", expected).withColumn("gaps", (F.col("e") - F.col("actual")).cast("long"))
    return g.where("gaps > 0").select(*by, F.col("e").cast("long").alias("expected"), "actual", "gaps", F.round(F.col("gaps") / F.col("e") * 100, 6).alias("gap_pct"))


def _calendar() -> Column:
    """hour, day, business day (daily stocks), week or month end: what a row's ideal timeline is made of."""
    c = by_code(CALENDARS, "day")
    return F.when((c == "day") & (F.col("asset_class") == "Stock"), "business day").otherwise(c)


def _after(a: str, b: str) -> Column:
    """Microseconds from a to b."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return at(b) - at(a)


_HOUR, _DAY = 3_600_000_000, 86_400_000_000


def _on_calendar(calendar: Column, first: str, date: str) -> Column:
    """Whether a date is a point of the ideal timeline that starts at `first`."""
    daily = _after(first, date) % _DAY == 0
    return (
        F.when(calendar == "hour", _after(first, date) % _HOUR == 0)
        .when(calendar == "week", _after(first, date) % (7 * _DAY) == 0)
        .when(calendar == "month end", daily & (F.last_day(date) == F.to_date(date)))
        .when(calendar == "business day", daily & F.weekday(date).between(0, 4))
        .otherwise(daily)
    )


def _calendar_points(calendar: Column, first: str, last: str) -> Column:
    """How many points an ideal timeline from first to last has, without making one."""
    days = F.floor(_after(first, last) / _DAY) + 1
    w, r = F.weekday(first), days % 7
    business = F.floor(days / 7) * 5 + F.greatest(F.lit(0), F.least(r, 5 - w)) + F.greatest(F.lit(0), w + r - 7)
    months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + 1
    # The last month's end counts if the last date has reached it, at the first date's time of day.
    ended = (F.last_day(last) == F.to_date(last)) & (_after(first, last) % _DAY >= 0) & (F.date_format(last, "HH:mm:ss.SSSSSS") >= F.date_format(first, "HH:mm:ss.SSSSSS"))
    return (
        F.when(calendar == "hour", F.floor(_after(first, last) / _HOUR) + 1)
        .when(calendar == "week", F.floor(_after(first, last) / (7 * _DAY)) + 1)
        .when(calendar == "month end", months - F.when(ended, 0).otherwise(1))
        .when(calendar == "business day", business)
        .otherwise(days)
        .cast("long")
    )


def gap_scan(bars: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Rows, missing points and completeness of each group against its ideal timeline: hours, days (business days for stocks), weeks or month ends.

    The timeline is counted by calendar arithmetic, and the candles that lie on it are; no point of it is made.
    """
    span = stage(bars.groupBy(*by, "asset_class").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count("*").alias("n_rows")), "gap-spans")
    rows = meet(bars.select(*by, "asset_class", "date"), span.select(*by, "asset_class", "a"), (*by, "asset_class"), "inner")
    found = rows.groupBy(*by, "asset_class").agg(F.count_distinct(F.when(_on_calendar(_calendar(), "a", "date"), F.col("date"))).alias("found"))
    g = meet(span, found, (*by, "asset_class")).withColumn("ideal", _calendar_points(_calendar(), "a", "b"))
    return g.select(*by, "n_rows", (F.col("ideal") - F.col("found")).alias("gap_count"), F.round(F.col("n_rows") / F.col("ideal") * 100, 6).alias("completeness"))


def missing_candles(bars: DataFrame, step: str, by: tuple[str, ...] = ("asset_symbol",)) -> DataFrame:
    """Timestamps of each group's ideal timeline that have no candle. Points are made inside gaps alone, between a candle and the next.

    Candles off the timeline (other than a whole number of steps after the first) end a gap but fill no point.
    """
    dates = bars.select(*by, "date").distinct()
    w = ordered(by)
    first = F.min("date").over(Window.partitionBy(*by))
    seconds = F.expr(f"unix_seconds(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {step})")
    since = lambda c: F.unix_seconds(c.cast("timestamp")) - F.unix_seconds(F.col("_first").cast("timestamp"))
    g = dates.withColumns({"_next": F.lead("date").over(w), "_first": first}).withColumn("_step", seconds)
    # The points strictly between a candle and the next are those of numbers k to n.
    g = g.withColumns({"_k": F.floor(since(F.col("date")) / F.col("_step")) + 1, "_n": F.ceil(since(F.col("_next")) / F.col("_step")) - 1}).where("_k <= _n")
    point = F.timestamp_seconds(F.unix_seconds(F.col("_first").cast("timestamp")) + F.col("_i") * F.col("_step"))
    return g.withColumn("_i", F.explode(F.sequence("_k", "_n"))).select(*by, point.cast("timestamp_ntz").alias("date"))


def islands(bars: DataFrame, seconds: int, by: tuple[str, ...] = BY) -> DataFrame:
    """Unbroken stretches of candles at most `seconds` apart: by, island (from 1), first_date, last_date, candles and the gap in seconds to the next."""
    w = ordered(by)
    at = lambda c: F.unix_seconds(c.cast("timestamp"))
    b = bars.select(*by, "date").withColumn("_new", (F.coalesce(at(F.col("date")) - at(F.lag("date").over(w)) > seconds, F.lit(True))).cast("long"))
    g = b.withColumn("island", F.sum("_new").over(w)).groupBy(*by, "island").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("candles"))
    nxt = F.lead("first_date").over(Window.partitionBy(*by).orderBy("island"))
    return g.withColumn("gap_seconds", at(nxt) - at(F.col("last_date")))


def frozen(bars: DataFrame, threshold: int = 5, by: tuple[str, ...] = BY) -> DataFrame:
    """Groups with more than `threshold` candles that close as the one before."""
    f = bars.withColumn("p", F.lag("close").over(ordered(by))).groupBy(*by).agg(F.count_if(F.col("close") == F.col("p")).alias("frozen"), F.count("*").alias("n"))
    return f.where(F.col("frozen") > threshold).select(*by, "frozen", "n", F.round(F.col("frozen") / F.col("n") * 100, 6).alias("frozen_pct"))


def outliers(bars: DataFrame, k: float = 5.0, by: tuple[str, ...] = BY) -> DataFrame:
    """Candles of each group whose log return is more than k deviations off the mean; both are those of the symbol over all its intervals."""
    p = F.lag("close").over(ordered(by))
    r = bars.withColumn("r", F.log(F.try_divide(F.col("close"), p)))
    stats = r.groupBy("asset_symbol").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    return r.join(stats, "asset_symbol").where(F.abs(F.col("r") - F.col("m")) > k * F.col("s")).groupBy(*by).agg(F.count("*").alias("spike_candles"))


def duplicate_timestamps(bars: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    return bars.groupBy(*by, "date").agg(F.count("*").alias("occurs")).where("occurs > 1")


def drift(bars: DataFrame, steps: tuple[int, ...] = (3600, 86400, 604800), by: tuple[str, ...] = BY) -> DataFrame:
    """Candles of each group that follow the one before at none of the usual distances (in seconds)."""
    at = lambda c: F.unix_seconds(c.cast("timestamp"))
    d = bars.withColumn("_d", at(F.col("date")) - at(F.lag("date").over(ordered(by))))
    return d.where(F.col("_d").isNotNull() & ~F.col("_d").isin(*steps)).groupBy(*by).agg(F.count("*").alias("drift_events"))


def ml_summary(bars: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    return bars.groupBy(*by).agg(F.count("*").alias("row_count"), F.min("date").alias("start_date"), F.max("date").alias("end_date"))


def rsi_snapshot(bars: DataFrame, window: int = 14, rows: int = 30, by: tuple[str, ...] = BY) -> DataFrame:
    """Simple-mean RSI of the last row, from the last `rows` rows."""
    last = latest(bars, rows, by)
    w = ordered(by)
    d = last.withColumn("_d", F.col("close") - F.lag("close").over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    near = latest(d.where(F.col("_n") > window), window, by)
    g = near.groupBy(*by).agg(F.avg(F.greatest("_d", F.lit(0.0))).alias("gain"), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).alias("loss"))
    return g.select(*by, F.round(100 - 100 / (1 + F.col("gain") / (F.col("loss") + 1e-9)), 2).alias("rsi"))


def atr_snapshot(bars: DataFrame, window: int = 14, rows: int = 30, by: tuple[str, ...] = BY) -> DataFrame:
    """Simple-mean average true range of the last row, from the last `rows` rows."""
    last = latest(bars, rows, by)
    p = F.lag("close").over(ordered(by))
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p))
    d = last.withColumn("_tr", true_range).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return latest(d.where(F.col("_n") > window), window, by).groupBy(*by).agg(F.round(F.avg("_tr"), 4).alias("atr"))


def top_correlations(bars: DataFrame, assets: int = 10, n: int = 5) -> DataFrame:
    """The n strongest correlations of closes among the most volatile assets."""
    top = volatility_scan(bars, ("asset_symbol",)).orderBy(F.desc("volatility"), "asset_symbol").limit(assets).select("asset_symbol")
    pairs = pair_correlations(bars.join(F.broadcast(top), "asset_symbol", "left_semi"))  # `assets` rows
    return pairs.orderBy(F.desc("correlation"), "a", "b").limit(n)


def sector_comparison(bars: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Mean volatility of the series of each class, and the asset of its riskiest one."""
    risk = change(bars, by).groupBy("asset_class", *by).agg(F.stddev_samp("change_pct").alias("v"))
    return risk.groupBy("asset_class").agg(F.round(F.avg("v"), 6).alias("avg_vol"), F.max_by("asset_symbol", F.struct("v", "asset_symbol")).alias("max_risk"))


def data_volume(bars: DataFrame) -> DataFrame:
    g = bars.groupBy("asset_symbol", "asset_class", "interval").agg(F.count("*").alias("total_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return g.orderBy(F.desc("total_rows"), "asset_symbol", "interval")


def pair_correlations(bars: DataFrame, least: int = 5) -> DataFrame:
    """Correlation of closes of every pair of assets on common dates, by blocks of assets. Of candles of one asset and date the last close by size counts."""
    one = bars.groupBy("asset_symbol", "date").agg(F.max("close").alias("close"))
    return pair_sums(one, "asset_symbol", "date", "close").select("a", "b", F.when(F.col("n") < least, 0.0).otherwise(F.round("correlation", 6)).alias("correlation"))


def moments(df: DataFrame, col: str, by: tuple[str, ...] = BY) -> DataFrame:
    """Skewness and excess kurtosis, biased and bias-corrected."""
    n = F.count(col)
    g = df.groupBy(*by).agg(n.alias("n"), F.skewness(col).alias("g1"), F.kurtosis(col).alias("g2"))
    n = F.col("n")
    return g.select(*by, F.round("g1", 6).alias("skew_biased"), F.round("g2", 6).alias("kurt_biased"), F.round(F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"), 6).alias("skew"), F.round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6), 6).alias("kurt"))


def freshness(bars: DataFrame, now: str) -> DataFrame:
    """Age tiers of each group's last candle: crypto trades around the clock (1 and 24 hours), stocks do not (24 and 72)."""
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))) / 3600
    crypto = F.col("asset_class") == "Crypto"
    tier = F.when(age < F.when(crypto, 1).otherwise(24), "fresh").when(age < F.when(crypto, 24).otherwise(72), "aging").otherwise("stale")
    return bars.groupBy("asset_symbol", "interval", "asset_class").agg(F.max("date").alias("last")).select("asset_symbol", "interval", "last", tier.alias("tier"))


def downsample(bars: DataFrame, points: int, by: tuple[str, ...] = BY) -> DataFrame:
    """Candles of equal row counts, at most `points` per group."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    b = bars.withColumn("bucket", F.floor((F.row_number().over(ordered(by)) - 1) / F.ceil(n / F.lit(points))))
    return b.groupBy(*by, "bucket").agg(F.min("date").alias("date"), F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))
