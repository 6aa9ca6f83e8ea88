"""Registered profilers and statistics over silver: two classes, three intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.operators import indicators, modelling, profile, statistics
from tallow.plans.registry import add
from tallow.sources.bars import bars_1d, bars_1h, silver

_BY = "PARTITION BY asset_symbol, interval"
_R = f"r AS (SELECT *, ln(close / lag(close) OVER ({_BY} ORDER BY date)) AS r FROM silver)"


def _spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with impossible values in some hours."""
    return bars_1h(spark, sf_dir).withColumns({"close": F.when(F.hour("date") == 3, -F.col("close")).otherwise(F.col("close")), "volume": F.when(F.hour("date") == 5, -F.col("volume")).otherwise(F.col("volume"))})


add("profile_anomalies", lambda s, d: profile.anomalies(_spoiled(s, d)).select("asset_symbol", "date", "close", "volume"), "WITH x AS (SELECT asset_symbol, date, CASE WHEN hour(date) = 3 THEN -close ELSE close END AS close, CASE WHEN hour(date) = 5 THEN -volume ELSE volume END AS volume FROM bars_1h) SELECT * FROM x WHERE close <= 0 OR volume < 0")
add("profile_summary", lambda s, d: profile.ml_summary(silver(s, d)), "SELECT asset_symbol, interval, count(*) AS row_count, min(date) AS start_date, max(date) AS end_date FROM silver GROUP BY ALL")
add("profile_data_volume", lambda s, d: profile.data_volume(silver(s, d)), "SELECT asset_symbol, asset_class, interval, count(*) AS total_rows, min(date) AS first_date, max(date) AS last_date FROM silver GROUP BY ALL ORDER BY total_rows DESC")
add(
    "profile_timeline",
    lambda s, d: profile.timeline(silver(s, d)),
    "WITH g AS (SELECT asset_symbol, interval, count(*) AS actual, (epoch(max(date)) - epoch(min(date))) / 60 / CASE interval WHEN '1h' THEN 60 WHEN '1wk' THEN 10080 ELSE 1440 END + 1 AS e FROM silver GROUP BY asset_symbol, interval), h AS (SELECT *, trunc(e - actual)::BIGINT AS gaps FROM g) SELECT asset_symbol, interval, trunc(e)::BIGINT AS expected, actual, gaps, round(gaps / e * 100, 6) AS gap_pct FROM h WHERE gaps > 0",
)
add(
    "profile_gap_scan",
    lambda s, d: profile.gap_scan(silver(s, d)),
    """WITH g AS (SELECT asset_symbol, asset_class, interval, min(date) AS a, max(date) AS b, count(*) AS n_rows FROM silver GROUP BY ALL),
    t AS (SELECT asset_symbol, asset_class, interval, n_rows, unnest(CASE interval WHEN '1h' THEN generate_series(a, b, INTERVAL 1 HOUR) WHEN '1wk' THEN generate_series(a, b, INTERVAL 7 DAY) ELSE generate_series(a, b, INTERVAL 1 DAY) END) AS date FROM g),
    k AS (SELECT * FROM t WHERE interval <> '1d' OR asset_class <> 'Stock' OR isodow(date) <= 5)
    SELECT k.asset_symbol, k.interval, n_rows, count(*) FILTER (WHERE s.date IS NULL) AS gap_count, round(n_rows / count(*) * 100, 6) AS completeness FROM k LEFT JOIN silver s ON k.asset_symbol = s.asset_symbol AND k.interval = s.interval AND k.date = s.date GROUP BY k.asset_symbol, k.interval, n_rows""",
)
_FLAT = f"f AS (SELECT asset_symbol, interval, date, CASE WHEN day(date) < 15 THEN 7.0 ELSE close END AS close FROM silver), p AS (SELECT *, lag(close) OVER ({_BY} ORDER BY date) AS p FROM f)"
add(
    "profile_frozen",
    lambda s, d: profile.frozen(silver(s, d).withColumn("close", F.when(F.dayofmonth("date") < 15, 7.0).otherwise(F.col("close")))),
    f"WITH {_FLAT} SELECT asset_symbol, interval, count(*) FILTER (WHERE close = p) AS frozen, count(*) AS n, round(count(*) FILTER (WHERE close = p) / count(*) * 100, 6) AS frozen_pct FROM p GROUP BY ALL HAVING frozen > 5",
)
for _name, _k in (("profile_outliers", 5.0), ("profile_outliers_2", 2.0)):
    add(_name, lambda s, d, k=_k: profile.outliers(silver(s, d), k), f"WITH {_R}, m AS (SELECT asset_symbol, avg(r) AS m, stddev(r) AS s FROM r GROUP BY 1) SELECT asset_symbol, interval, count(*) AS spike_candles FROM r JOIN m USING (asset_symbol) WHERE abs(r - m) > {_k} * s GROUP BY ALL")
add("profile_duplicates", lambda s, d: profile.duplicate_timestamps(silver(s, d).unionByName(silver(s, d).where("interval = '1wk'"))), "WITH u AS (SELECT * FROM silver UNION ALL SELECT * FROM silver WHERE interval = '1wk') SELECT asset_symbol, interval, date, count(*) AS occurs FROM u GROUP BY ALL HAVING occurs > 1")
add("profile_drift", lambda s, d: profile.drift(silver(s, d)), f"WITH p AS (SELECT asset_symbol, interval, date, lag(date) OVER ({_BY} ORDER BY date) AS p FROM silver) SELECT asset_symbol, interval, count(*) AS drift_events FROM p WHERE p IS NOT NULL AND epoch(date) - epoch(p) NOT IN (3600, 86400, 604800) GROUP BY ALL")
_LAST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_symbol, interval ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY asset_symbol, interval) AS total FROM silver) WHERE rn <= 30)"
add(
    "profile_rsi",
    lambda s, d: profile.rsi_snapshot(silver(s, d)),
    f"WITH {_LAST}, c AS (SELECT *, close - lag(close) OVER ({_BY} ORDER BY date) AS d FROM l WHERE total > 14) SELECT asset_symbol, interval, round(100 - 100 / (1 + avg(greatest(d, 0)) / (avg(greatest(-d, 0)) + 1e-9)), 2) AS rsi FROM c WHERE rn <= 14 GROUP BY ALL",
)
add(
    "profile_atr",
    lambda s, d: profile.atr_snapshot(silver(s, d)),
    f"WITH {_LAST}, c AS (SELECT *, lag(close) OVER ({_BY} ORDER BY date) AS p FROM l WHERE total > 14) SELECT asset_symbol, interval, round(avg(greatest(high - low, abs(high - p), abs(low - p))), 4) AS atr FROM c WHERE rn <= 14 GROUP BY ALL",
)
_CH = "c AS (SELECT *, (close - lag(close) OVER (PARTITION BY asset_symbol ORDER BY date)) / lag(close) OVER (PARTITION BY asset_symbol ORDER BY date) * 100 AS x FROM {})"
add(
    "profile_top_correlations",
    lambda s, d: profile.top_correlations(bars_1h(s, d), 3, 2),
    f"WITH {_CH.format('bars_1h')}, v AS (SELECT asset_symbol FROM (SELECT asset_symbol, stddev(x) AS v FROM c GROUP BY 1) ORDER BY round(v, 6) DESC, 1 LIMIT 3), b AS (SELECT * FROM bars_1h WHERE asset_symbol IN (SELECT asset_symbol FROM v)) SELECT x.asset_symbol AS a, y.asset_symbol AS b, CASE WHEN count(*) < 5 THEN 0.0 ELSE round(corr(x.close, y.close), 6) END AS correlation FROM b x JOIN b y ON x.date = y.date AND x.asset_symbol < y.asset_symbol GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 2",
)
add(
    "profile_sectors",
    lambda s, d: profile.sector_comparison(silver(s, d)),
    f"WITH p AS (SELECT *, lag(close) OVER ({_BY} ORDER BY date) AS p FROM silver), v AS (SELECT asset_class, asset_symbol, interval, stddev((close - p) / p * 100) AS v FROM p GROUP BY ALL) SELECT asset_class, round(avg(v), 6) AS avg_vol, max_by(asset_symbol, v) AS max_risk FROM v GROUP BY 1",
)
add(
    "profile_freshness",
    lambda s, d: profile.freshness(silver(s, d), "2024-02-01 00:00:00"),
    "WITH m AS (SELECT asset_symbol, interval, asset_class, max(date) AS last FROM silver GROUP BY ALL), a AS (SELECT *, (epoch(TIMESTAMP '2024-02-01') - epoch(last)) / 3600 AS age FROM m) SELECT asset_symbol, interval, last, CASE WHEN age < CASE asset_class WHEN 'Crypto' THEN 1 ELSE 24 END THEN 'fresh' WHEN age < CASE asset_class WHEN 'Crypto' THEN 24 ELSE 72 END THEN 'aging' ELSE 'stale' END AS tier FROM a",
)
# Statistics of the windowed features.
_COLS = ["close", "volume", "sma_50", "roc_10", "returns_1p", "log_returns", "hl_ratio", "close_position", "with_inf"]


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.window_indicators(bars_1d(spark, sf_dir)).withColumn("with_inf", F.when(F.dayofyear("date") == 1, F.lit(float("inf"))).otherwise(F.col("close"))).withColumn("typical", (F.col("high") + F.col("low") + F.col("close") * 4) / 6)


_FEATURED = """w AS (SELECT *, lag(close) OVER (PARTITION BY asset_symbol ORDER BY date) AS p, lag(close, 10) OVER (PARTITION BY asset_symbol ORDER BY date) AS p10, count(close) OVER o AS n50, avg(close) OVER o AS m50 FROM bars_1d WINDOW o AS (PARTITION BY asset_symbol ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
f AS (SELECT asset_symbol, close, volume, CASE WHEN n50 = 50 THEN m50 END AS sma_50, (close / p10 - 1) * 100 AS roc_10, close / p - 1 AS returns_1p, ln(close / p) AS log_returns, (high - low) / close AS hl_ratio, (close - low) / CASE WHEN high = low THEN 1 ELSE high - low END AS close_position, CASE WHEN dayofyear(date) = 1 THEN 'inf'::DOUBLE ELSE close END AS with_inf, (high + low + close * 4) / 6 AS typical FROM w)"""
_FINITE = [*[c for c in _COLS if c != "with_inf"], "typical"]
_PAIRS = [(a, b) for i, a in enumerate(_FINITE) for b in _FINITE[i + 1 :]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 6) AS correlation FROM f" for a, b in _PAIRS)
add("stats_correlations", lambda s, d: statistics.correlations(_featured(s, d), _FINITE), f"WITH {_FEATURED} {_CORR}")
add("stats_high_correlations", lambda s, d: statistics.high_correlations(_featured(s, d), _FINITE), f"WITH {_FEATURED} SELECT * FROM ({_CORR}) WHERE abs(correlation) > 0.9")
_STAT = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature_name, count({c}) AS count, {'NULL::DOUBLE' if c == 'with_inf' else f'round(avg({c}), 4)'} AS mean, {'NULL::DOUBLE' if c == 'with_inf' else f'round(stddev({c}), 4)'} AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75,
    {'NULL::DOUBLE' if c == 'with_inf' else f'round(max({c}), 4)'} AS max, coalesce(bool_or(isinf({c})), false) AS has_inf, count(*) FILTER (WHERE {c} IS NULL) AS null_count, {'NULL::DOUBLE' if c in ('with_inf', 'returns_1p') else f'round(corr({c}, returns_1p), 6)'} AS target_correlation FROM f"""
    for c in _COLS
)
_FLAGS = "SELECT *, CASE WHEN has_inf THEN 'FAIL_INF' WHEN null_count > 0 THEN 'FAIL_NULL' WHEN feature_name IN ('returns_1p', 'returns_5p', 'returns_10p', 'returns_20p', 'log_returns') THEN 'LEAKAGE' ELSE 'PASS' END AS quality_flag FROM st"


def _finite(df: DataFrame) -> DataFrame:
    """Figures of features with infinities are not numbers; they are left empty for the comparison."""
    bad = F.col("has_inf")
    return df.withColumns({c: F.when(~bad, F.col(c)) for c in ("mean", "std", "max", "target_correlation")})


add("stats_features", lambda s, d: _finite(statistics.feature_statistics(_featured(s, d), _COLS)), f"WITH {_FEATURED}, st AS ({_STAT}) {_FLAGS}")
add("stats_top_features", lambda s, d: statistics.top_features(statistics.feature_statistics(_featured(s, d), _COLS)), f"WITH {_FEATURED}, st AS ({_STAT}), q AS ({_FLAGS}) SELECT feature_name, target_correlation FROM q WHERE quality_flag = 'PASS' ORDER BY abs(target_correlation) DESC, 1 LIMIT 15")
add("stats_missing", lambda s, d: statistics.missing_table(_featured(s, d), _COLS), f"WITH {_FEATURED}, m AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS null_count, round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 6) AS null_pct FROM f''' for c in _COLS)}) SELECT * FROM m WHERE null_count > 0")
_RANKS = ", ".join(f"rank() OVER (PARTITION BY asset_symbol ORDER BY {c}) + (count(*) OVER (PARTITION BY asset_symbol, {c}) - 1) / 2 AS {c}" for c in ("close", "volume", "hl_ratio"))
add(
    "stats_spearman",
    lambda s, d: statistics.spearman(_featured(s, d), ["close", "volume", "hl_ratio"], ("asset_symbol",)),
    f"WITH {_FEATURED}, k AS (SELECT asset_symbol, {_RANKS} FROM f) " + " UNION ALL ".join(f"SELECT asset_symbol, '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 6) AS correlation FROM k GROUP BY asset_symbol" for a, b in (("close", "volume"), ("close", "hl_ratio"), ("volume", "hl_ratio"))),
)
add(
    "stats_autocorrelation",
    lambda s, d: statistics.autocorrelation(_featured(s, d).withColumn("abs_returns", F.abs("returns_1p")), "abs_returns", by=("asset_symbol",)).withColumn("lag", F.col("lag").cast("long")),
    """WITH a AS (SELECT asset_symbol, date, abs(close / lag(close) OVER (PARTITION BY asset_symbol ORDER BY date) - 1) AS r FROM bars_1d), b AS (SELECT *, row_number() OVER (PARTITION BY asset_symbol ORDER BY date) AS rn FROM a WHERE r IS NOT NULL), c AS (SELECT asset_symbol, rn, r - avg(r) OVER (PARTITION BY asset_symbol) AS x FROM b WHERE rn <= 1000),
    s AS (SELECT c.asset_symbol, e.rn - c.rn AS lag, sum(c.x * e.x) AS s FROM c JOIN c e ON c.asset_symbol = e.asset_symbol AND e.rn - c.rn BETWEEN 0 AND 50 GROUP BY 1, 2) SELECT asset_symbol, lag, round(s / max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY asset_symbol), 6) AS autocorrelation FROM s""",
)
add(
    "stats_histogram",
    lambda s, d: statistics.histogram(silver(s, d), "volume"),
    "WITH m AS (SELECT asset_symbol, interval, min(volume) AS lo, max(volume) AS hi FROM silver GROUP BY ALL) SELECT asset_symbol, interval, coalesce(least(floor((volume - lo) * 40 / nullif(hi - lo, 0)), 39), 0)::BIGINT AS bin, count(*) AS n FROM silver JOIN m USING (asset_symbol, interval) GROUP BY ALL",
)
add(
    "stats_class_balance",
    lambda s, d: statistics.value_counts(modelling.targets(silver(s, d)), "target_direction", ("asset_symbol", "interval")),
    f"WITH t AS (SELECT asset_symbol, interval, coalesce(lead(close) OVER ({_BY} ORDER BY date) > close, false)::INT AS target_direction FROM silver), c AS (SELECT asset_symbol, interval, target_direction, count(*) AS n FROM t GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY asset_symbol, interval), 6) AS share FROM c",
)
add(
    "stats_target",
    lambda s, d: modelling.targets(silver(s, d)).groupBy("asset_symbol", "interval").agg(F.count("target").alias("n"), F.round(F.stddev_samp("target"), 6).alias("std"), *[F.round(F.percentile("target", F.lit(p)), 8).alias(f"p{int(p * 100)}") for p in (0.05, 0.5, 0.95)]),
    f"WITH t AS (SELECT asset_symbol, interval, lead(close) OVER ({_BY} ORDER BY date) / close - 1 AS t FROM silver) SELECT asset_symbol, interval, count(t) AS n, round(stddev(t), 6) AS std, round(quantile_cont(t, 0.05), 8) AS p5, round(quantile_cont(t, 0.5), 8) AS p50, round(quantile_cont(t, 0.95), 8) AS p95 FROM t GROUP BY ALL",
)
# The forest's scores have no SQL; a test holds them against a feature that makes the target.
add("stats_importance", lambda s, d: statistics.importances(_featured(s, d).drop("with_inf"), _FINITE))
