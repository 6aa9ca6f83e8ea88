"""SQL over the candle views: each text runs in Spark and, with the views' definitions before it, in the oracle."""

TEXT = {
    "sql_filters": "SELECT asset_symbol, date, round(high - low, 6) AS spread, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS direction, coalesce(nullif(volume, 0), -1) AS vol FROM bars_1d WHERE asset_symbol IN ('A', 'N') AND close IS NOT NULL AND asset_symbol LIKE 'A%' AND date BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1995-12-31'",
    "sql_aggregates": "SELECT asset_symbol, count(*) AS n, count(DISTINCT date) AS days, round(sum(volume), 4) AS vol, round(avg(close), 6) AS mean, min(low) AS lo, max(high) AS hi, round(stddev_samp(close), 6) AS sd, round(corr(open, close), 6) AS r, count(*) FILTER (WHERE close > open) AS ups, sum(CASE WHEN close < open THEN 1 ELSE 0 END) AS downs FROM bars_1d GROUP BY asset_symbol",
    "sql_percentiles": "SELECT asset_symbol, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY close), 6) AS q25, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY close), 6) AS q50, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY close), 6) AS q75 FROM bars_1d GROUP BY asset_symbol",
    "sql_rollup": "SELECT asset_symbol, year(date) AS y, round(sum(volume), 4) AS vol, count(*) AS n FROM bars_1d GROUP BY ROLLUP (asset_symbol, year(date))",
    "sql_cube": "SELECT asset_symbol, year(date) AS y, count(*) AS n FROM bars_1d GROUP BY CUBE (asset_symbol, year(date))",
    "sql_grouping_sets": "SELECT asset_symbol, year(date) AS y, count(*) AS n FROM bars_1d GROUP BY GROUPING SETS ((asset_symbol), (year(date)))",
    "sql_having": "SELECT asset_symbol, month(date) AS m, count(*) AS n FROM bars_1d GROUP BY asset_symbol, month(date) HAVING n > 50",
    "sql_ranks": "SELECT asset_symbol, date, row_number() OVER (PARTITION BY asset_symbol ORDER BY volume DESC, date) AS rn, rank() OVER (PARTITION BY asset_symbol ORDER BY volume DESC) AS rk, dense_rank() OVER (PARTITION BY asset_symbol ORDER BY volume DESC) AS dr FROM bars_1d",
    "sql_topk": "WITH r AS (SELECT asset_symbol, date, close, row_number() OVER (PARTITION BY asset_symbol ORDER BY close DESC, date) AS rn FROM bars_1d) SELECT asset_symbol, date, close, rn FROM r WHERE rn <= 2",
    "sql_first_last": "SELECT DISTINCT asset_symbol, first_value(close) OVER w AS first_close, last_value(close) OVER w AS last_close FROM bars_1d WINDOW w AS (PARTITION BY asset_symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "sql_running_sum": "SELECT asset_symbol, date, round(sum(volume) OVER (PARTITION BY asset_symbol ORDER BY date), 4) AS running FROM bars_1d",
    "sql_moving_average": "SELECT asset_symbol, date, round(avg(close) OVER (PARTITION BY asset_symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS sma_7, round(avg(close) OVER (PARTITION BY asset_symbol ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 6) AS before_30 FROM bars_1d",
    "sql_lag_change": "SELECT asset_symbol, date, round((close - lag(close, 1) OVER w) / lag(close, 1) OVER w * 100, 6) AS change_pct, lead(close) OVER w AS next_close FROM bars_1d WINDOW w AS (PARTITION BY asset_symbol ORDER BY date)",
    "sql_pair_correlation": "WITH a AS (SELECT date, close FROM bars_ord WHERE asset_symbol = '1-URGENT'), b AS (SELECT date, close FROM bars_ord WHERE asset_symbol = '2-HIGH') SELECT count(*) AS n, round(corr(a.close, b.close), 6) AS r FROM a JOIN b ON a.date = b.date",
    "sql_cross_join_mean": "WITH m AS (SELECT year(date) AS y, month(date) AS mo, avg(close) AS c FROM bars_1d GROUP BY year(date), month(date)), t AS (SELECT avg(c) AS total FROM m) SELECT y, mo, CASE WHEN c > total THEN 'above' ELSE 'below' END AS side FROM m CROSS JOIN t",
    "sql_union_limits": "SELECT * FROM (SELECT asset_symbol, date, volume FROM bars_1d ORDER BY volume DESC, asset_symbol, date LIMIT 5) x UNION ALL SELECT * FROM (SELECT asset_symbol, date, volume FROM bars_1h ORDER BY volume DESC, asset_symbol, date LIMIT 5) y",
    "sql_distinct": "SELECT DISTINCT asset_symbol, year(date) AS y FROM bars_ord",
    "sql_duplicates": "WITH u AS (SELECT asset_symbol, date FROM bars_1d UNION ALL SELECT asset_symbol, date FROM bars_1d WHERE asset_symbol = 'A') SELECT asset_symbol, date, count(*) AS n FROM u GROUP BY asset_symbol, date HAVING count(*) > 1",
    "sql_scalar_subquery": "SELECT asset_symbol, date, close FROM bars_1d WHERE date >= (SELECT max(date) FROM bars_1d) - INTERVAL '30' DAY",
    "sql_not_in": "SELECT DISTINCT asset_symbol FROM bars_ord WHERE asset_symbol NOT IN (SELECT asset_symbol FROM bars_ord WHERE asset_symbol LIKE '1%' OR asset_symbol LIKE '3%')",
    "sql_not_exists": "SELECT a.asset_symbol, a.date FROM bars_1h a WHERE NOT EXISTS (SELECT 1 FROM bars_1h b WHERE b.asset_symbol <> a.asset_symbol AND b.date = a.date AND b.close > a.close)",
    "sql_lateral_alias": "SELECT asset_symbol, date, gap FROM (SELECT asset_symbol, date, round((open - lag(close) OVER (PARTITION BY asset_symbol ORDER BY date)) / close * 100, 6) AS gap FROM bars_1d) x WHERE abs(gap) > 50",
    "sql_macro_full_outer": "WITH a AS (SELECT date, close FROM bars_1h WHERE asset_symbol = 'click'), b AS (SELECT date, close FROM bars_1h WHERE asset_symbol = 'view'), c AS (SELECT date, close FROM bars_1h WHERE asset_symbol = 'purchase') SELECT coalesce(a.date, b.date, c.date) AS date, a.close AS x, b.close AS y, c.close AS z FROM a FULL OUTER JOIN b ON a.date = b.date FULL OUTER JOIN c ON a.date = c.date",
    "sql_star_join": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name",
}
