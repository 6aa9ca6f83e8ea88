"""Registered feature tables, engineering, folds and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.functions.windows import ordered
from tallow.operators import indicators, modelling, warehouse
from tallow.plans.registry import add
from tallow.sources.bars import bars_1d, bars_1h, silver
from tallow.sources.stages import stage

PRICES = ["open", "high", "low", "close", "prev_close", "prev_high", "prev_low", "daily_volatility"]
SMALL = ["returns_1p", "returns_5p", "returns_10p", "returns_20p", "log_returns", "hl_ratio", "close_position", "bb_percentage", "volume_ratio", "funding_rate"]
KEYS = ["asset_symbol", "asset_class", "exchange", "interval", "date"]


def _rounded(df: DataFrame, places: int) -> DataFrame:
    """Prices and ratios to eight places, what sums many rows to fewer."""
    return df.select(*[F.round(c, 8 if c in PRICES + SMALL else places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def gold_of(spark: SparkSession, sf_dir: str, asset_class: str) -> DataFrame:
    """Gold of one class. Its clean bars are written once: assets, calendar and facts are made from that."""
    own = silver(spark, sf_dir).where(F.col("asset_class") == asset_class)
    bars = stage(warehouse.dedup(warehouse.clean(own)), "clean-bars")
    assets, dates, intervals = warehouse.dim_assets(bars), warehouse.calendar_of(bars), warehouse.dim_interval(spark)
    return warehouse.gold(warehouse.load_facts(bars, assets, dates, intervals), assets, intervals)


def features_of(asset_class: str, places: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = indicators.features(gold_of(spark, sf_dir, asset_class))
        extras = silver(spark, sf_dir).where(F.col("asset_class") == asset_class)
        return _rounded(indicators.class_features(done, extras, asset_class), places)

    return run


_P = "PARTITION BY asset_symbol, interval"
_O = f"OVER ({_P} ORDER BY date)"
_LAST = lambda n: f"OVER ({_P} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_FULL = lambda f, x, n: f"CASE WHEN count({x}) {_LAST(n)} = {n} THEN {f}({x}) {_LAST(n)} END"
_EMA = lambda n: f"(1 - 2.0 / {n + 1}) * e.e{n} + 2.0 / {n + 1} * s.close"
_FEATURES = f"""WITH RECURSIVE k AS (SELECT * FROM silver WHERE asset_class = '{{0}}' AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0),
a AS (SELECT *, row_number() {_O} AS rn, count(*) OVER ({_P}) AS n, lag(close) {_O} AS p1, lag(close, 5) {_O} AS p5, lag(close, 10) {_O} AS p10, lag(close, 20) {_O} AS p20, lag(volume) {_O} AS pv, lag(high) {_O} AS ph, lag(low) {_O} AS pl, (high + low + close) / 3 * volume AS tv FROM k),
s AS MATERIALIZED (SELECT *, close - p1 AS d, greatest(high - low, abs(high - p1), abs(low - p1)) AS tr, avg(greatest(high - low, abs(high - p1), abs(low - p1))) {_LAST(14)} AS seed FROM a WHERE n >= 200),
e AS (SELECT asset_symbol, interval, date, rn, close AS e12, close AS e26, close AS e50, close AS e200, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0.0::DOUBLE AS atr, NULL::DOUBLE AS sig FROM s WHERE rn = 1
  UNION ALL SELECT s.asset_symbol, s.interval, s.date, s.rn, {_EMA(12)}, {_EMA(26)}, {_EMA(50)}, {_EMA(200)}, (1 - 1.0 / 14) * e.up + 1.0 / 14 * greatest(s.d, 0), (1 - 1.0 / 14) * e.dn + 1.0 / 14 * greatest(-s.d, 0),
    CASE WHEN s.rn < 14 THEN 0 WHEN s.rn = 14 THEN s.seed ELSE (13 * e.atr + s.tr) / 14 END,
    CASE WHEN s.rn < 26 THEN NULL WHEN s.rn = 26 THEN ({_EMA(12)}) - ({_EMA(26)}) ELSE 0.8 * e.sig + 0.2 * (({_EMA(12)}) - ({_EMA(26)})) END
  FROM e JOIN s ON s.asset_symbol = e.asset_symbol AND s.interval = e.interval AND s.rn = e.rn + 1),
w AS (SELECT *, {_FULL('min', 'low', 14)} AS l14, {_FULL('max', 'high', 14)} AS h14, {_FULL('avg', 'close', 20)} AS m20, {_FULL('stddev_pop', 'close', 20)} AS s20, {_FULL('avg', 'close', 50)} AS s50, {_FULL('avg', 'close', 100)} AS s100, {_FULL('avg', 'close', 200)} AS s200, {_FULL('sum', 'tv', 14)} / nullif({_FULL('sum', 'volume', 14)}, 0) AS vwap,
  {_FULL('avg', 'volume', 20)} AS v20, sum(CASE WHEN close < p1 THEN -volume ELSE volume END) OVER ({_P} ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv, avg(close) {_LAST(7)} AS sma_7, avg(close) {_LAST(30)} AS sma_30 FROM s),
x AS (SELECT *, 100 * (close - l14) / nullif(h14 - l14, 0) AS stoch_k FROM w), y AS (SELECT *, {_FULL('avg', 'stoch_k', 3)} AS stoch_d FROM x),
f AS (SELECT y.asset_symbol, asset_class, exchange, y.interval, y.date, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 4) AS volume, round(high - low, 8) AS daily_volatility, round(sma_7, 4) AS sma_7, round(sma_30, 4) AS sma_30,
  round(CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + up / dn) END, 4) AS rsi_14, round(e12, 4) AS ema_12, round(e26, 4) AS ema_26, round(e50, 4) AS ema_50, round(e200, 4) AS ema_200, round(e12 - e26, 4) AS macd, round(sig, 4) AS macd_signal, round(e12 - e26 - sig, 4) AS macd_histogram, round(atr, 4) AS atr_14,
  round((close / p10 - 1) * 100, 4) AS roc_10, round((close / p20 - 1) * 100, 4) AS roc_20, round(stoch_k, 4) AS stoch_k, round(stoch_d, 4) AS stoch_d, round(s50, 4) AS sma_50, round(s100, 4) AS sma_100, round(s200, 4) AS sma_200,
  round(m20 + 2 * s20, 4) AS bb_upper, round(m20, 4) AS bb_middle, round(m20 - 2 * s20, 4) AS bb_lower, round(4 * s20 / nullif(m20, 0) * 100, 4) AS bb_width, round((close - (m20 - 2 * s20)) / nullif(4 * s20, 0), 8) AS bb_percentage, round(obv, 4) AS obv, round(vwap, 4) AS vwap,
  round(v20, 4) AS volume_sma_20, round(volume / CASE WHEN v20 = 0 THEN 1 ELSE v20 END, 8) AS volume_ratio, round(close / p1 - 1, 8) AS returns_1p, round(close / p5 - 1, 8) AS returns_5p, round(close / p10 - 1, 8) AS returns_10p, round(close / p20 - 1, 8) AS returns_20p, round(ln(close / p1), 8) AS log_returns,
  round((high - low) / close, 8) AS hl_ratio, round((close - low) / CASE WHEN high = low THEN 1 ELSE high - low END, 8) AS close_position, round(p1, 8) AS prev_close, round(pv, 4) AS prev_volume, round(ph, 8) AS prev_high, round(pl, 8) AS prev_low{{1}}
  FROM y JOIN e ON y.asset_symbol = e.asset_symbol AND y.interval = e.interval AND y.rn = e.rn WHERE y.rn >= 200)
SELECT * FROM f WHERE stoch_d IS NOT NULL AND bb_percentage IS NOT NULL AND vwap IS NOT NULL"""
add("features_stock", features_of("Stock", 4), _FEATURES.format("Stock", ""))
add("features_crypto", features_of("Crypto", 6), _FEATURES.format("Crypto", ", round(turnover, 4) AS turnover, round(open_interest, 4) AS open_interest, round(funding_rate, 8) AS funding_rate").replace(", 4)", ", 6)"))


def _dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = indicators.dashboard_recursive(bars_1d(spark, sf_dir))
    return out.select("asset_symbol", "date", *[F.round(c, 6).alias(c) for c in ("ema_dash_9", "ema_dash_21", "ema_dash_50", "macd_dash", "macd_dash_signal", "macd_dash_histogram")])


_E9 = {n: f"(1 - 2.0 / {n + 1}) * e.e{n} + 2.0 / {n + 1} * s.close" for n in (9, 12, 21, 26, 50)}
add(
    "indicators_dashboard_ema",
    _dashboard,
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT asset_symbol, date, close, row_number() OVER (PARTITION BY asset_symbol ORDER BY date) AS rn FROM bars_1d),
    e AS (SELECT asset_symbol, date, rn, {', '.join(f'close AS e{n}' for n in _E9)}, 0.0::DOUBLE AS sig FROM s WHERE rn = 1 UNION ALL SELECT s.asset_symbol, s.date, s.rn, {', '.join(_E9.values())}, 0.8 * e.sig + 0.2 * (({_E9[12]}) - ({_E9[26]})) FROM e JOIN s ON s.asset_symbol = e.asset_symbol AND s.rn = e.rn + 1)
    SELECT asset_symbol, date, round(e9, 6) AS ema_dash_9, round(e21, 6) AS ema_dash_21, round(e50, 6) AS ema_dash_50, round(e12 - e26, 6) AS macd_dash, round(sig, 6) AS macd_dash_signal, round(e12 - e26 - sig, 6) AS macd_dash_histogram FROM e""",
)


def _stationary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = indicators.features(gold_of(spark, sf_dir, "Stock"))
    return modelling.stationary(done).select(*KEYS[:1], "interval", "date", *[F.round(c, 6).alias(c) for c in [*modelling.DISTANCES, *modelling.OVER_CLOSE]])


_RAW = _FEATURES.format("Stock", ", e12, e26, e50, e200, sig, atr, sma_7 AS r7, sma_30 AS r30, s50, s100, s200, vwap AS rvwap, close AS rc, high - low AS dv")
_DIST = {"sma_7": "r7", "sma_30": "r30", "sma_50": "s50", "sma_100": "s100", "sma_200": "s200", "ema_12": "e12", "ema_26": "e26", "ema_50": "e50", "ema_200": "e200", "vwap": "rvwap"}
add(
    "features_stationary",
    _stationary,
    _RAW.replace("SELECT * FROM f WHERE", f"SELECT asset_symbol, interval, date, {', '.join(f'round(rc / {x} - 1, 6) AS {c}_dist' for c, x in _DIST.items())}, round((e12 - e26) / rc, 6) AS macd_pct, round(sig / rc, 6) AS macd_sig_pct, round((e12 - e26 - sig) / rc, 6) AS macd_hist_pct, round(atr / rc, 6) AS atr_pct, round(dv / rc, 6) AS volatility_pct FROM f WHERE"),
)


def _non_stationary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the feature table for a model, as one row per column."""
    left = modelling.drop_non_stationary(indicators.features(gold_of(spark, sf_dir, "Stock"))).drop(*KEYS)
    return left.agg(*[F.count(c).alias(c) for c in left.columns]).unpivot([], left.columns, "feature", "known")


_LEFT = ["rsi_14", "roc_10", "roc_20", "stoch_k", "stoch_d", "bb_percentage", "volume_ratio", "returns_1p", "returns_5p", "returns_10p", "returns_20p", "log_returns", "hl_ratio", "close_position"]
add("features_left", _non_stationary, _FEATURES.format("Stock", "").replace("SELECT * FROM f WHERE", "UNPIVOT (SELECT " + ", ".join(f"count({c}) AS {c}" for c in _LEFT) + " FROM f WHERE") + f") ON {', '.join(_LEFT)} INTO NAME feature VALUE known")


def _lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = modelling.lag_features(indicators.features(gold_of(spark, sf_dir, "Crypto")))
    return f.select("asset_symbol", "date", F.round("rsi_14_lag1", 4).alias("rsi_14_lag1"), *[F.round(c, 6).alias(c) for c in ("log_returns_lag1", "volume_lag1", "price_vs_sma", "vol_spike", "momentum_24h")])


_KEPT = "g AS (SELECT * FROM f WHERE stoch_d IS NOT NULL AND bb_percentage IS NOT NULL AND vwap IS NOT NULL)"
_ROWS = "OVER (PARTITION BY asset_symbol, interval ORDER BY date)"
add(
    "features_lagged",
    _lagged,
    _FEATURES.format("Crypto", ", ln(close / p1) AS lr, volume AS rv, close AS rc, sma_30 AS r30, v20").replace("SELECT * FROM f WHERE stoch_d IS NOT NULL AND bb_percentage IS NOT NULL AND vwap IS NOT NULL", f", {_KEPT} SELECT asset_symbol, date, lag(rsi_14) {_ROWS} AS rsi_14_lag1, round(lag(lr) {_ROWS}, 6) AS log_returns_lag1, round(lag(rv) {_ROWS}, 6) AS volume_lag1, round((rc - r30) / r30, 6) AS price_vs_sma, round(rv / v20, 6) AS vol_spike, round(rc / lag(rc, 24) {_ROWS} - 1, 6) AS momentum_24h FROM g").replace("rn >= 200)\n,", "rn >= 200),"),
)
add(
    "features_past_returns",
    lambda s, d: modelling.past_returns(silver(s, d)).select("asset_symbol", "interval", "date", *[F.round(c, 8).alias(c) for c in ("past_return_1h", "past_return_5h", "past_return_10h", "past_return_20h", "past_log_return")]),
    "SELECT asset_symbol, interval, date, " + ", ".join(f"round(close / lag(close, {n}) {_O} - 1, 8) AS past_return_{n}h" for n in (1, 5, 10, 20)) + f", round(ln(close / lag(close) {_O}), 8) AS past_log_return FROM silver",
)
add(
    "features_log_returns",
    lambda s, d: modelling.log_returns(silver(s, d)).select("asset_symbol", "interval", "date", *[F.round(f"{c}_logret", 8).alias(f"{c}_logret") for c in ("open", "high", "low", "close", "volume")]),
    "WITH l AS (SELECT asset_symbol, interval, date, " + ", ".join(f"round(ln({c} / lag({c}) {_O}), 8) AS {c}_logret" for c in ("open", "high", "low", "close", "volume")) + " FROM silver) SELECT * FROM l WHERE close_logret IS NOT NULL",
)
_Z = lambda x: f"({x} - {_FULL('avg', x, 50)}) / nullif({_FULL('stddev_samp', x, 50)}, 0)"
add(
    "features_turnover",
    lambda s, d: modelling.turnover_features(silver(s, d).where("asset_class = 'Crypto'")).select("asset_symbol", "date", *[F.round(c, 6).alias(c) for c in ("turnover_ratio", "turnover_change_1p", "turnover_change_5p", "turnover_ratio_zscore_50")]),
    f"WITH t AS (SELECT *, turnover / nullif(volume, 0) AS tr FROM silver WHERE asset_class = 'Crypto') SELECT asset_symbol, date, round(tr, 6) AS turnover_ratio, round(turnover / nullif(lag(turnover) {_O}, 0) - 1, 6) AS turnover_change_1p, round(turnover / nullif(lag(turnover, 5) {_O}, 0) - 1, 6) AS turnover_change_5p, round({_Z('tr')}, 6) AS turnover_ratio_zscore_50 FROM t",
)
add(
    "features_open_interest",
    lambda s, d: modelling.aux_features(silver(s, d).where("asset_class = 'Crypto'"), "open_interest", "oi").select("asset_symbol", "date", *[F.round(c, 6).alias(c) for c in ("oi_change_1p", "oi_change_5p", "oi_change_20p", "oi_zscore_50")]),
    "SELECT asset_symbol, date, " + ", ".join(f"round(open_interest / nullif(lag(open_interest, {n}) {_O}, 0) - 1, 6) AS oi_change_{n}p" for n in (1, 5, 20)) + f", round({_Z('open_interest')}, 6) AS oi_zscore_50 FROM silver WHERE asset_class = 'Crypto'",
)
add(
    "targets_4",
    lambda s, d: modelling.targets(silver(s, d), 4, drop_last=True).select("asset_symbol", "interval", "date", F.round("target", 8).alias("target"), "target_direction"),
    f"WITH t AS (SELECT asset_symbol, interval, date, lead(close, 4) {_O} / close - 1 AS t FROM silver) SELECT asset_symbol, interval, date, round(t, 8) AS target, (t > 0)::INT AS target_direction FROM t WHERE t IS NOT NULL",
)
add("split_by_date", lambda s, d: modelling.split_by_date(silver(s, d), "1996-01-01 00:00:00").groupBy("asset_symbol", "interval", "is_train").agg(F.count("*").alias("n")), "SELECT asset_symbol, interval, date < TIMESTAMP '1996-01-01' AS is_train, count(*) AS n FROM silver GROUP BY ALL")
_SIDES = f"t AS (SELECT *, lead(close) {_O} / close - 1 AS target, coalesce(lead(close) {_O} > close, false)::INT AS up, row_number() {_O} AS rn, count(*) OVER ({_P}) AS n FROM silver), u AS (SELECT *, rn <= floor(n * 0.8) AS tr FROM t)"
_SIDE = ", ".join(f"count(*) FILTER (WHERE {x}) AS {k}_rows, min(date) FILTER (WHERE {x}) AS {k}_from, max(date) FILTER (WHERE {x}) AS {k}_to, count(*) FILTER (WHERE {x} AND target IS NULL) AS {k}_null_targets, round(avg(target) FILTER (WHERE {x}), 8) AS {k}_mean, round(avg(up) FILTER (WHERE {x}) * 100, 4) AS {k}_up_pct" for k, x in (("train", "tr"), ("test", "NOT tr")))
add("split_report", lambda s, d: modelling.split_report(modelling.split_by_date(modelling.targets(silver(s, d)))), f"WITH {_SIDES}, r AS (SELECT asset_symbol, interval, {_SIDE} FROM u GROUP BY ALL) SELECT *, train_to < test_from AS no_overlap FROM r")
add(
    "standardise_all",
    lambda s, d: modelling.standardise(bars_1d(s, d).withColumn("every", F.lit(True)), ["close"], "every").select("asset_symbol", "date", F.round("close", 6).alias("close")),
    "WITH m AS (SELECT asset_symbol, interval, avg(close) AS m, stddev_pop(close) AS s FROM bars_1d GROUP BY ALL) SELECT asset_symbol, date, round((close - m) / s, 6) AS close FROM bars_1d JOIN m USING (asset_symbol, interval)",
)
# Walk-forward folds. Rows lie in many folds; labels look ahead within a fold's own side only.
_FOLDS = """WITH RECURSIVE b AS (SELECT asset_symbol, interval, min(date) AS lo, max(date) AS hi FROM bars_1d GROUP BY ALL),
f AS (SELECT asset_symbol, interval, lo AS s, hi, 1 AS k FROM b WHERE lo + INTERVAL 6 MONTH + INTERVAL 1 MONTH <= hi UNION ALL SELECT asset_symbol, interval, s + INTERVAL 1 MONTH, hi, k + 1 FROM f WHERE s + INTERVAL 1 MONTH + INTERVAL 6 MONTH + INTERVAL 1 MONTH <= hi),
r AS (SELECT x.*, k, x.date >= s + INTERVAL 6 MONTH AS is_test FROM f JOIN {0} x ON x.asset_symbol = f.asset_symbol AND x.interval = f.interval AND x.date >= s AND x.date < s + INTERVAL 6 MONTH + INTERVAL 1 MONTH),
z AS (SELECT asset_symbol, interval, k, count(*) FILTER (WHERE NOT is_test) AS n_train, count(*) FILTER (WHERE is_test) AS n_test FROM r GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY asset_symbol, interval ORDER BY k) AS fold_id FROM z WHERE n_train >= 100 AND n_test >= 20)"""


def _fold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = modelling.assign_folds(bars_1d(spark, sf_dir))
    rows = modelling.targets(rows, by=("asset_symbol", "interval", "fold_id", "is_test"))
    return rows.groupBy("asset_symbol", "fold_id", "is_test").agg(F.count("*").alias("n"), F.sum("target_direction").alias("ups"))


def _oos(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallow.plans.catalog import predictions

    rows = modelling.assign_folds(predictions(spark, sf_dir)).where("is_test")
    return rows.groupBy("asset_symbol").agg(F.count("*").alias("n"), F.count_distinct("fold_id").alias("folds"), F.round(F.avg((F.col("prediction") == F.col("actual")).cast("int")), 6).alias("accuracy"))


add("backtest_folds", lambda s, d: modelling.assign_folds(bars_1d(s, d)).groupBy("asset_symbol", "fold_id").agg(F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train")), _FOLDS.format("bars_1d") + " SELECT asset_symbol, fold_id, n_test, n_train FROM q")
add(
    "fold_labels",
    _fold_labels,
    _FOLDS.format("bars_1d") + ", l AS (SELECT r.asset_symbol, fold_id, is_test, coalesce(lead(close) OVER (PARTITION BY r.asset_symbol, r.interval, r.k, is_test ORDER BY date) > close, false)::INT AS up FROM r JOIN q ON r.asset_symbol = q.asset_symbol AND r.interval = q.interval AND r.k = q.k) SELECT asset_symbol, fold_id, is_test, count(*) AS n, sum(up)::BIGINT AS ups FROM l GROUP BY ALL",
)
_PR = "pr AS (SELECT asset_symbol, interval, date, coalesce(close / lag(close) OVER (PARTITION BY asset_symbol ORDER BY date) - 1 > 0, false)::INT AS prediction, 0.5 + abs((close - low) / CASE WHEN high = low THEN 1 ELSE high - low END - 0.5) AS confidence, coalesce(lead(close) OVER (PARTITION BY asset_symbol ORDER BY date) > close, false)::INT AS actual FROM bars_1d), pp AS (SELECT *, CASE WHEN prediction = 1 THEN confidence ELSE 1 - confidence END AS proba FROM pr)"
add("oos_accuracy", _oos, _FOLDS.format("pr").replace("WITH RECURSIVE b AS", f"WITH RECURSIVE {_PR}, b AS") + " SELECT r.asset_symbol, count(*) AS n, count(DISTINCT fold_id) AS folds, round(avg((prediction = actual)::INT), 6) AS accuracy FROM r JOIN q ON r.asset_symbol = q.asset_symbol AND r.interval = q.interval AND r.k = q.k WHERE is_test GROUP BY 1")


def _with_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallow.plans.catalog import predictions

    return predictions(spark, sf_dir).withColumn("proba", F.when(F.col("prediction") == 1, F.col("confidence")).otherwise(1 - F.col("confidence")))


_T = ", ".join(f"({t}::DOUBLE)" for t in modelling.THRESHOLDS)
add(
    "threshold_sweep",
    lambda s, d: modelling.threshold_sweep(_with_proba(s, d)),
    f"""WITH {_PR}, t AS (SELECT * FROM (VALUES {_T}) t(threshold)), a AS (SELECT count(*) AS n, avg(((proba >= 0.5)::INT = actual)::INT) AS base FROM pp),
    c AS (SELECT threshold, count(*) AS coverage, count(*) FILTER (WHERE proba >= 0.5 AND actual = 1) AS tp, count(*) FILTER (WHERE proba >= 0.5 AND actual = 0) AS fp, count(*) FILTER (WHERE proba < 0.5 AND actual = 1) AS fn, count(*) FILTER (WHERE proba < 0.5 AND actual = 0) AS tn FROM t JOIN pp ON greatest(proba, 1 - proba) >= threshold GROUP BY 1),
    d AS (SELECT threshold, coverage, round((tp + tn) / coverage, 4) AS accuracy, coalesce(round(tp / nullif(tp + fp, 0), 4), 0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 4), 0) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 4), 0) AS f1, round(coverage / n * 100, 1) AS coverage_pct, base FROM c, a)
    SELECT threshold, coverage, accuracy, precision, recall, f1, coverage_pct, round(accuracy - base, 4) AS delta_vs_baseline, row_number() OVER (ORDER BY accuracy DESC, threshold) = 1 AS is_best FROM d""",
)
_T2 = ", ".join(f"({t}::DOUBLE)" for t in modelling.TWO_SIDED)
add(
    "two_sided_filter",
    lambda s, d: modelling.two_sided_filter(_with_proba(s, d)),
    f"WITH {_PR}, t AS (SELECT * FROM (VALUES {_T2}) t(threshold)), c AS (SELECT threshold, count(*) AS n, avg(((proba > 0.5)::INT = actual)::INT) AS acc FROM t JOIN pp ON proba > threshold OR proba < 1 - threshold GROUP BY 1) SELECT threshold, round(n / (SELECT count(*) FROM pp) * 100, 4) AS coverage_pct, round(acc, 6) AS accuracy, round(n / (SELECT count(*) FROM pp) * 7, 4) AS trades_day FROM c",
)
add("long_only", lambda s, d: modelling.long_only(_with_proba(s, d)), f"WITH {_PR} SELECT count(*) AS signals, round(avg(actual), 6) AS win_rate FROM pp WHERE proba > 0.58")
add("out_of_sample", lambda s, d: modelling.out_of_sample(_with_proba(s, d), "1996-01-01 00:00:00"), f"WITH {_PR} SELECT asset_symbol, interval, date > TIMESTAMP '1996-01-01' AS is_oos, count(*) AS n, round(avg((prediction = actual)::INT), 6) AS accuracy FROM pp GROUP BY ALL")
