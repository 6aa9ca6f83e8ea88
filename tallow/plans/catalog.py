"""The registered queries of the market-analytics part, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.functions.windows import ordered
from tallow.operators import indicators, modelling, profile, warehouse
from tallow.plans.registry import QUERIES, SQL, add, rounded
from tallow.plans.sqlsuite import TEXT
from tallow.sources.bars import bars_1d, bars_1h, bars_ord, silver, table

def _sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {"bars_1d": bars_1d, "bars_1h": bars_1h, "bars_ord": bars_ord}
        for name, f in frames.items():
            if name in text:
                f(spark, sf_dir).createOrReplaceTempView(name)
        for name in ("orders", "customer", "nation", "region"):
            if f" {name} " in text:
                table(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(text)

    return run


for _name, _text in TEXT.items():
    add(_name, _sql_query(_text), _text)


def gold_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = warehouse.dedup(warehouse.clean(bars_1d(spark, sf_dir)))
    assets, dates, intervals = warehouse.dim_assets(bars, "Stock"), warehouse.dim_date(spark), warehouse.dim_interval(spark)
    return warehouse.gold(warehouse.load_facts(bars, assets, dates, intervals), assets, intervals)


def flagship_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = indicators.window_indicators(gold_1d(spark, sf_dir))
    g = g.na.drop(subset=["sma_200"])
    return rounded(modelling.stationary(g).select("asset_symbol", "date", "close", "sma_7", "sma_30", "sma_200", "returns_1p", "log_returns", "sma_200_dist", "volatility_pct").withColumn("close", F.round("close", 8)), "asset_symbol", "date", "close", places=6)


_GOLD = """g AS (SELECT asset_symbol, date, open, high, low, close, volume, high - low AS daily_volatility,
  avg(close) OVER (PARTITION BY asset_symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sma_7,
  avg(close) OVER (PARTITION BY asset_symbol ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS sma_30
  FROM bars_1d WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0)"""
_W = "OVER (PARTITION BY asset_symbol ORDER BY date{})"
_ROLL = lambda f, x, n: f"CASE WHEN count({x}) OVER (PARTITION BY asset_symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN {f}({x}) OVER (PARTITION BY asset_symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
_LAG = lambda x, n=1: f"lag({x}, {n}) OVER (PARTITION BY asset_symbol ORDER BY date)"

add(
    "flagship_features",
    flagship_features,
    f"""WITH {_GOLD}, i AS (SELECT *, {_ROLL('avg', 'close', 200)} AS sma_200, {_LAG('close')} AS p FROM g)
    SELECT asset_symbol, date, round(close, 8) AS close, round(sma_7, 6) AS sma_7, round(sma_30, 6) AS sma_30, round(sma_200, 6) AS sma_200, round(close / p - 1, 6) AS returns_1p, round(ln(close / p), 6) AS log_returns,
      round(close / sma_200 - 1, 6) AS sma_200_dist, round(daily_volatility / close, 6) AS volatility_pct FROM i WHERE sma_200 IS NOT NULL""",
)
add("gold_analytics", lambda s, d: rounded(gold_1d(s, d).drop("asset_class", "exchange", "interval").withColumns({c: F.round(c, 6) for c in ("sma_7", "sma_30")}), "asset_symbol", "date"), f"WITH {_GOLD} SELECT asset_symbol, date, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 8) AS volume, round(daily_volatility, 8) AS daily_volatility, round(sma_7, 6) AS sma_7, round(sma_30, 6) AS sma_30 FROM g")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["roc_10", "roc_20", "stoch_k", "stoch_d", "sma_50", "sma_100", "bb_upper", "bb_lower", "bb_width", "obv", "vwap", "volume_ratio", "returns_5p", "returns_20p", "hl_ratio", "close_position", "prev_close", "prev_volume"]
    return rounded(indicators.window_indicators(bars_1d(spark, sf_dir)).select("asset_symbol", "date", *cols), "asset_symbol", "date", "prev_close", places=6)


add(
    "indicators_window",
    _windows,
    f"""WITH a AS (SELECT *, {_LAG('close')} AS p1, {_LAG('close', 5)} AS p5, {_LAG('close', 10)} AS p10, {_LAG('close', 20)} AS p20, (high + low + close) / 3 * volume AS tv, {_LAG('volume')} AS pv FROM bars_1d),
    b AS (SELECT *, {_ROLL('min', 'low', 14)} AS l14, {_ROLL('max', 'high', 14)} AS h14, {_ROLL('avg', 'close', 20)} AS m20, {_ROLL('stddev_pop', 'close', 20)} AS s20, {_ROLL('sum', 'tv', 14)} AS tv14, {_ROLL('sum', 'volume', 14)} AS v14, {_ROLL('avg', 'volume', 20)} AS vs20, {_ROLL('avg', 'close', 50)} AS s50, {_ROLL('avg', 'close', 100)} AS s100 FROM a),
    c AS (SELECT *, 100 * (close - l14) / nullif(h14 - l14, 0) AS k FROM b)
    SELECT asset_symbol, date, round((close / p10 - 1) * 100, 6) AS roc_10, round((close / p20 - 1) * 100, 6) AS roc_20, round(k, 6) AS stoch_k, round({_ROLL('avg', 'k', 3)}, 6) AS stoch_d, round(s50, 6) AS sma_50, round(s100, 6) AS sma_100,
      round(m20 + 2 * s20, 6) AS bb_upper, round(m20 - 2 * s20, 6) AS bb_lower, round(4 * s20 / nullif(m20, 0) * 100, 6) AS bb_width, round(sum(CASE WHEN close < p1 THEN -volume ELSE volume END) OVER (PARTITION BY asset_symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS obv,
      round(tv14 / nullif(v14, 0), 6) AS vwap, round(volume / CASE WHEN vs20 = 0 THEN 1 ELSE vs20 END, 6) AS volume_ratio, round(close / p5 - 1, 6) AS returns_5p, round(close / p20 - 1, 6) AS returns_20p, round((high - low) / close, 6) AS hl_ratio,
      round((close - low) / CASE WHEN high - low = 0 THEN 1 ELSE high - low END, 6) AS close_position, p1 AS prev_close, round(pv, 6) AS prev_volume FROM c""",
)
add(
    "indicators_recursive",
    lambda s, d: rounded(indicators.recursive_indicators(bars_1d(s, d)).select("asset_symbol", "date", "rsi_14", "ema_12", "ema_26", "macd", "macd_signal", "atr_14"), "asset_symbol", "date", places=6),
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY asset_symbol ORDER BY date) AS rn, close - lag(close) OVER (PARTITION BY asset_symbol ORDER BY date) AS d, lag(close) OVER (PARTITION BY asset_symbol ORDER BY date) AS p FROM bars_1d),
    t AS MATERIALIZED (SELECT *, greatest(high - low, abs(high - p), abs(low - p)) AS tr FROM b), s AS MATERIALIZED (SELECT *, avg(tr) OVER (PARTITION BY asset_symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS seed FROM t),
    e AS (SELECT asset_symbol, date, rn, close AS e12, close AS e26, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0.0::DOUBLE AS atr, NULL::DOUBLE AS sig FROM s WHERE rn = 1
      UNION ALL SELECT s.asset_symbol, s.date, s.rn, (1 - 2.0 / 13) * e.e12 + 2.0 / 13 * s.close, (1 - 2.0 / 27) * e.e26 + 2.0 / 27 * s.close, (1 - 1.0 / 14) * e.up + 1.0 / 14 * greatest(s.d, 0), (1 - 1.0 / 14) * e.dn + 1.0 / 14 * greatest(-s.d, 0),
        CASE WHEN s.rn < 14 THEN 0 WHEN s.rn = 14 THEN s.seed ELSE (13 * e.atr + s.tr) / 14 END,
        CASE WHEN s.rn < 26 THEN NULL WHEN s.rn = 26 THEN ((1 - 2.0 / 13) * e.e12 + 2.0 / 13 * s.close) - ((1 - 2.0 / 27) * e.e26 + 2.0 / 27 * s.close) ELSE 0.8 * e.sig + 0.2 * (((1 - 2.0 / 13) * e.e12 + 2.0 / 13 * s.close) - ((1 - 2.0 / 27) * e.e26 + 2.0 / 27 * s.close)) END
      FROM e JOIN s ON s.asset_symbol = e.asset_symbol AND s.rn = e.rn + 1)
    SELECT asset_symbol, date, CASE WHEN rn >= 14 THEN round(CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + up / dn) END, 6) END AS rsi_14, CASE WHEN rn >= 12 THEN round(e12, 6) END AS ema_12, CASE WHEN rn >= 26 THEN round(e26, 6) END AS ema_26,
      CASE WHEN rn >= 26 THEN round(e12 - e26, 6) END AS macd, CASE WHEN rn >= 34 THEN round(sig, 6) END AS macd_signal, round(atr, 6) AS atr_14 FROM e""",
)
add(
    "indicators_dashboard",
    lambda s, d: rounded(indicators.dashboard_indicators(bars_1d(s, d)).select("asset_symbol", "date", "rsi_sma_14", "atr_sma_14", "bb_samp_upper", "vwap_cum", "obv_sign"), "asset_symbol", "date", places=6),
    f"""WITH a AS (SELECT *, {_LAG('close')} AS p, row_number() {_W.format('')} AS rn FROM bars_1d), b AS (SELECT *, close - p AS d, greatest(high - low, abs(high - p), abs(low - p)) AS tr, greatest(close - p, 0) AS g, greatest(p - close, 0) AS l FROM a),
    c AS (SELECT *, avg(CASE WHEN d IS NULL THEN NULL ELSE g END) OVER w14 AS ag, avg(CASE WHEN d IS NULL THEN NULL ELSE l END) OVER w14 AS al, {_ROLL('avg', 'tr', 14)} AS atr, {_ROLL('avg', 'close', 20)} AS m, {_ROLL('stddev_samp', 'close', 20)} AS sd,
      sum((high + low + close) / 3 * volume) OVER wu AS tv, sum(volume) OVER wu AS v, sum(coalesce(sign(d) * volume, 0)) OVER wu AS obv FROM b WINDOW w14 AS (PARTITION BY asset_symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), wu AS (PARTITION BY asset_symbol ORDER BY date ROWS UNBOUNDED PRECEDING))
    SELECT asset_symbol, date, CASE WHEN rn > 14 THEN round(100 - 100 / (1 + ag / CASE WHEN al = 0 THEN 1e-10 ELSE al END), 6) END AS rsi_sma_14, round(atr, 6) AS atr_sma_14, round(m + 2 * sd, 6) AS bb_samp_upper, round(tv / CASE WHEN v = 0 THEN 1 ELSE v END, 6) AS vwap_cum, round(obv, 6) AS obv_sign FROM c""",
)
add("targets", lambda s, d: rounded(modelling.targets(bars_1d(s, d)).select("asset_symbol", "date", "target", "target_direction"), "asset_symbol", "date"), "WITH a AS (SELECT asset_symbol, date, lead(close) OVER (PARTITION BY asset_symbol ORDER BY date) / close - 1 AS t FROM bars_1d) SELECT asset_symbol, date, round(t, 8) AS target, coalesce(t > 0, false)::INT AS target_direction FROM a")
add("split_standardise", lambda s, d: rounded(modelling.standardise(modelling.split_by_position(bars_1d(s, d)), ["close"]).select("asset_symbol", "date", "is_train", "close"), "asset_symbol", "date"), "WITH a AS (SELECT *, row_number() OVER (PARTITION BY asset_symbol ORDER BY date) <= floor(count(*) OVER (PARTITION BY asset_symbol) * 0.8) AS is_train FROM bars_1d), m AS (SELECT asset_symbol, avg(close) AS m, stddev_pop(close) AS s FROM a WHERE is_train GROUP BY 1) SELECT asset_symbol, date, is_train, round((close - m) / s, 8) AS close FROM a JOIN m USING (asset_symbol)")
add("winsorise", lambda s, d: rounded(modelling.winsorise(bars_1d(s, d), ["close"]).select("asset_symbol", "date", "close"), "asset_symbol", "date"), "WITH q AS (SELECT quantile_cont(close, 0.01) AS lo, quantile_cont(close, 0.99) AS hi FROM bars_1d) SELECT asset_symbol, date, round(least(greatest(close, lo), hi), 8) AS close FROM bars_1d, q")
add("sequences", lambda s, d: modelling.sequences(modelling.targets(bars_1d(s, d)), ["open", "close"], 20).select("asset_symbol", "date", F.size("x").cast("long").alias("n"), F.round(F.col("x")[0][1], 8).alias("first_close"), F.round(F.col("x")[19][1], 8).alias("last_close")), f"WITH a AS (SELECT asset_symbol, date, row_number() {_W.format('')} AS rn, {_LAG('close', 20)} AS f, {_LAG('close', 1)} AS l FROM bars_1d) SELECT asset_symbol, date, 20::BIGINT AS n, round(f, 8) AS first_close, round(l, 8) AS last_close FROM a WHERE rn > 20")
add("dim_date", lambda s, d: warehouse.calendar_of(silver(s, d), 1).select("date_id", "date", "quarter", "month_name", F.col("week").cast("long").alias("week"), F.col("day_of_week").cast("long").alias("day_of_week"), "day_name", "is_business_day", "is_weekend"), "SELECT row_number() OVER (ORDER BY x) AS date_id, x::DATE AS date, quarter(x) AS quarter, monthname(x) AS month_name, week(x) AS week, dayofweek(x) AS day_of_week, dayname(x) AS day_name, dayofweek(x) BETWEEN 1 AND 5 AS is_business_day, dayofweek(x) IN (0, 6) AS is_weekend FROM (SELECT unnest(generate_series(min(date)::DATE, make_date(year(max(date)) + 1, 12, 28), INTERVAL 1 DAY)) AS x FROM silver)")


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after the first half of history are loaded, then the rest: nothing twice, nothing lost."""
    bars = bars_1d(spark, sf_dir)
    assets, dates, intervals = warehouse.dim_assets(bars, "Stock"), warehouse.dim_date(spark), warehouse.dim_interval(spark)
    have = warehouse.load_facts(bars.where("date < '1995-06-01'"), assets, dates, intervals)
    fresh = warehouse.load_facts(bars, assets, dates, intervals, have)
    return have.unionByName(fresh).groupBy("asset_id").agg(F.count("*").alias("n"), F.count_distinct("timestamp").alias("days"), F.round(F.sum("volume"), 4).alias("volume"))


add("facts_incremental", _incremental, "WITH a AS (SELECT asset_symbol, row_number() OVER (ORDER BY asset_symbol) AS asset_id FROM (SELECT DISTINCT asset_symbol FROM bars_1d)) SELECT asset_id, count(*) AS n, count(DISTINCT date) AS days, round(sum(volume), 4) AS volume FROM bars_1d JOIN a USING (asset_symbol) GROUP BY asset_id")
add("high_water_mark", lambda s, d: warehouse.high_water_mark(silver(s, d)), "SELECT asset_symbol, interval, max(date) AS last_date FROM silver GROUP BY ALL")


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_1d(spark, sf_dir)
    aux = bars_ord(spark, sf_dir).where("asset_symbol = '1-URGENT'").select("date", F.col("close").alias("rate")).crossJoin(b.select("asset_symbol", "interval").distinct())
    return warehouse.align_asof(b.select("asset_symbol", "interval", "date"), aux, "rate").drop("interval")


add("asof_alignment", _asof, "WITH x AS (SELECT date, close AS rate FROM bars_ord WHERE asset_symbol = '1-URGENT') SELECT b.asset_symbol, b.date, x.rate FROM bars_1d b ASOF LEFT JOIN x ON b.date >= x.date")
add("pivot_closes", lambda s, d: bars_1d(s, d).groupBy("date").pivot("asset_symbol").agg(F.max("close")).na.fill(0.0), "SELECT date, coalesce(max(close) FILTER (WHERE asset_symbol = 'A'), 0) AS \"A\", coalesce(max(close) FILTER (WHERE asset_symbol = 'N'), 0) AS \"N\", coalesce(max(close) FILTER (WHERE asset_symbol = 'R'), 0) AS \"R\" FROM bars_1d GROUP BY date")
_CH = "c AS (SELECT *, (close - lag(close) OVER (PARTITION BY asset_symbol ORDER BY date)) / lag(close) OVER (PARTITION BY asset_symbol ORDER BY date) * 100 AS change_pct FROM bars_1d)"
_LATEST = lambda src, n: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_symbol ORDER BY date DESC) AS rn_{n} FROM {src}) WHERE rn_{n} <= {n}"
add("profile_gainers", lambda s, d: profile.top_movers(bars_1d(s, d)), f"WITH {_CH} SELECT asset_symbol, date, close, round(change_pct, 6) AS change_pct FROM c WHERE change_pct IS NOT NULL ORDER BY 4 DESC, 1, 2 LIMIT 10")
add("profile_losers", lambda s, d: profile.top_movers(bars_1d(s, d), gainers=False), f"WITH {_CH} SELECT asset_symbol, date, close, round(change_pct, 6) AS change_pct FROM c WHERE change_pct IS NOT NULL ORDER BY 4, 1, 2 LIMIT 10")
add("profile_volatility", lambda s, d: profile.volatility_scan(bars_1d(s, d)).drop("interval"), f"WITH {_CH} SELECT asset_symbol, round(stddev_samp(change_pct), 6) AS volatility FROM c GROUP BY 1")
add("profile_zscore", lambda s, d: profile.last_zscore(bars_1d(s, d)).drop("interval"), f"WITH {_CH}, k AS (SELECT * FROM c WHERE change_pct IS NOT NULL), l AS ({_LATEST('k', 50)}) SELECT asset_symbol, round((max_by(change_pct, date) - avg(change_pct)) / stddev_samp(change_pct), 6) AS zscore FROM l GROUP BY 1 HAVING count(*) >= 30")
add("profile_ma_cross", lambda s, d: profile.ma_cross(bars_1d(s, d)).drop("interval"), f"WITH m AS (SELECT *, {_ROLL('avg', 'close', 50)} AS a, {_ROLL('avg', 'close', 200)} AS b FROM bars_1d), n AS (SELECT *, {_LAG('a')} AS pa, {_LAG('b')} AS pb FROM m), l AS ({_LATEST('n', 1)}) SELECT asset_symbol, CASE WHEN pa <= pb AND a > b THEN 'golden' WHEN pa >= pb AND a < b THEN 'death' ELSE 'none' END AS signal FROM l")
add("profile_squeeze", lambda s, d: profile.squeeze(bars_1d(s, d)).drop("interval"), f"WITH l AS ({_LATEST('bars_1d', 50)}), m AS (SELECT *, {_ROLL('stddev_samp', 'close', 20)} AS sd FROM l), n AS (SELECT *, {_ROLL('avg', 'sd', 20)} AS mm FROM m), k AS ({_LATEST('n', 1)}) SELECT asset_symbol, round(sd / nullif(mm, 0), 6) AS ratio, coalesce(sd / mm < 0.7, false) AS squeezed FROM k")
add("profile_dead", lambda s, d: profile.dead_assets(bars_1d(s, d)).drop("interval"), f"WITH l AS ({_LATEST('bars_1d', 7)}) SELECT asset_symbol, count(*) = 7 AND count(DISTINCT close) = 1 AS dead FROM l GROUP BY 1")
add("profile_spikes", lambda s, d: profile.volume_spikes(bars_ord(s, d), 2.0), "WITH m AS (SELECT *, avg(volume) OVER (PARTITION BY asset_symbol ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS mean FROM bars_ord) SELECT asset_symbol, date, volume, round(mean, 6) AS mean FROM m WHERE volume > mean * 2")
add("profile_spread", lambda s, d: profile.spread_outliers(bars_1d(s, d)), "SELECT asset_symbol, date, round((high - low) / close * 100, 6) AS spread_pct FROM bars_1d ORDER BY 3 DESC, 1, 2 LIMIT 10")
add("profile_gaps", lambda s, d: profile.overnight_gaps(bars_1d(s, d)), f"WITH g AS (SELECT asset_symbol, date, round((open - {_LAG('close')}) / {_LAG('close')} * 100, 6) AS gap_pct FROM bars_1d) SELECT * FROM g WHERE abs(gap_pct) > 2 ORDER BY abs(gap_pct) DESC, 1, 2 LIMIT 10")
_AUDITED = ["open", "high", "low", "close", "volume", "turnover", "open_interest", "funding_rate"]
add("profile_nulls", lambda s, d: profile.null_audit(silver(s, d), _AUDITED), " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS null_count, round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 6) AS null_pct FROM silver" for c in _AUDITED))
add("profile_describe", lambda s, d: profile.describe(silver(s, d), ["open", "high", "low", "close", "volume", "turnover", "open_interest", "funding_rate"]), "WITH a AS (SELECT unnest(['open', 'high', 'low', 'close', 'volume', 'turnover', 'open_interest', 'funding_rate']) AS feature_name, unnest([open, high, low, close, volume, turnover, open_interest, funding_rate]) AS x FROM silver) SELECT feature_name, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS max, count(*) FILTER (WHERE x IS NULL) AS null_count FROM a GROUP BY 1")
add("profile_missing", lambda s, d: profile.missing_candles(bars_1h(s, d), "1 HOUR"), "WITH g AS (SELECT asset_symbol, unnest(generate_series(min(date), max(date), INTERVAL 1 HOUR)) AS date FROM bars_1h GROUP BY 1) SELECT asset_symbol, date FROM g ANTI JOIN bars_1h USING (asset_symbol, date)")
add("profile_correlations", lambda s, d: profile.pair_correlations(bars_ord(s, d)), "WITH p AS (SELECT x.asset_symbol AS a, y.asset_symbol AS b, count(*) AS n, corr(x.close, y.close) AS c FROM bars_ord x JOIN bars_ord y ON x.date = y.date AND x.asset_symbol < y.asset_symbol GROUP BY 1, 2) SELECT a, b, CASE WHEN n < 5 THEN 0.0 ELSE round(c, 6) END AS correlation FROM p")
add("profile_moments", lambda s, d: profile.moments(bars_1d(s, d), "close").drop("interval"), "WITH m AS (SELECT asset_symbol, avg(close) AS m FROM bars_1d GROUP BY 1), c AS (SELECT b.asset_symbol, avg((close - m) ** 2) AS m2, avg((close - m) ** 3) AS m3, avg((close - m) ** 4) AS m4, skewness(close) AS s, kurtosis(close) AS k FROM bars_1d b JOIN m USING (asset_symbol) GROUP BY 1) SELECT asset_symbol, round(m3 / m2 ** 1.5, 6) AS skew_biased, round(m4 / m2 ** 2 - 3, 6) AS kurt_biased, round(s, 6) AS skew, round(k, 6) AS kurt FROM c")
add("downsample", lambda s, d: profile.downsample(bars_1d(s, d), 500).drop("interval").withColumn("volume", F.round("volume", 4)), "WITH n AS (SELECT *, row_number() OVER (PARTITION BY asset_symbol ORDER BY date) AS rn, count(*) OVER (PARTITION BY asset_symbol) AS n FROM bars_1d), k AS (SELECT *, floor((rn - 1) / ceil(n / 500))::BIGINT AS bucket FROM n) SELECT asset_symbol, bucket, min(date) AS date, min_by(open, date) AS open, max(high) AS high, min(low) AS low, max_by(close, date) AS close, round(sum(volume), 4) AS volume FROM k GROUP BY 1, 2")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in predictor, so that the backtest is reproducible: the sign of the last return, sure by the close's place in its range."""
    b = indicators.window_indicators(bars_1d(spark, sf_dir))
    return b.select("asset_symbol", "interval", "date", "open", "high", "low", "close", (F.coalesce(F.col("returns_1p"), F.lit(0.0)) > 0).cast("int").alias("prediction"), (F.lit(0.5) + F.abs(F.col("close_position") - 0.5)).alias("confidence"), F.coalesce(F.lead("close").over(ordered()) > F.col("close"), F.lit(False)).cast("int").alias("actual"))


_P = f"""a AS (SELECT *, {_LAG('close')} AS p, lead(close) OVER (PARTITION BY asset_symbol ORDER BY date) AS nx FROM bars_1d),
 pr AS (SELECT asset_symbol, date, high, low, close, coalesce(close / p - 1 > 0, false)::INT AS prediction, 0.5 + abs((close - low) / CASE WHEN high = low THEN 1 ELSE high - low END - 0.5) AS confidence, coalesce(nx > close, false)::INT AS actual FROM a)"""
add("evaluate_report", lambda s, d: rounded(modelling.classification_report(predictions(s, d))), f"WITH {_P}, c AS (SELECT count(*) FILTER (WHERE actual = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE actual = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE actual = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE actual = 0 AND prediction = 0) AS tn FROM pr) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM c")


from tallow.plans import checks, features, loads, scale  # noqa: E402, F401  (they register their queries)
