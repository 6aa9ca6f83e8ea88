from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallow.operators import indicators, modelling, statistics, warehouse
from tallow.plans import catalog
from tallow.session import object_store
from tallow.sources import sinks

SF = "/root/testdata/sf0.001"


def bars(spark, rows):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(s, "1h", t0 + timedelta(hours=i), float(o), float(h), float(lo), float(c), float(v)) for s, i, o, h, lo, c, v in rows], "asset_symbol string, interval string, date timestamp_ntz, open double, high double, low double, close double, volume double")


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", ["sql_aggregates", "gold_analytics", "features_stock", "profile_missing", "profile_gap_scan", "profile_frozen", "stats_features", "stats_autocorrelation", "asof_alignment", "facts_incremental", "backtest_folds", "threshold_sweep", "load_upsert", "scan_klines", "stream_candles"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "orders", "customer", "nation", "region"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(map(str, (r[c] for c in cols))) for r in df.collect()])
    rel = con.sql(catalog.SQL[name])
    want = sorted([tuple(map(str, (r[rel.columns.index(c)] for c in cols))) for r in rel.fetchall()])
    assert got == want


@pytest.mark.parametrize("name", ["features_log_returns", "features_past_returns"])
def test_returns_at_zeros_and_below_are_those_of_sql(spark, tmp_path, name):
    t0, values = datetime(2024, 1, 1), [2.0, 0.0, 0.0, 3.0, -1.0, -4.0, 0.0, 5.0, None, 6.0, 0.0, None, 1.0]
    rows = [(i, t0 + timedelta(hours=i, minutes=k), i, "view", x, "") for i, v in enumerate(values) for k, x in enumerate((4.0, 0.0 if i % 3 else 1.0, v))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df, rel = catalog.QUERIES[name](spark, str(tmp_path)), con.sql(catalog.SQL[name])
    got, want = (sorted(tuple(map(str, r)) for r in x) for x in (df.select(*rel.columns).collect(), rel.fetchall()))
    assert got == want and sum("inf" in r for row in got for r in row) > 5


def test_ewm_is_the_naive_loop():
    x = np.random.default_rng(0).normal(size=300)
    assert np.allclose(indicators.ewm(x, 2 / 13), pd.Series(x).ewm(span=12, adjust=False).mean(), atol=1e-12)
    assert np.isnan(indicators.ewm(x, 0.1, 14)[:13]).all()


def test_atr_is_zero_before_its_seed():
    assert (indicators.wilder_atr(np.full(5, 2.0), np.full(5, 1.0), np.full(5, 1.5)) == 0).all()


@pytest.mark.parametrize("n,kept", [(199, 0), (200, 1), (201, 2)])
def test_minimum_rows_and_warm_up(spark, n, kept):
    rng = np.random.default_rng(1)
    rows = [("A", i, 100, 102 + rng.random(), 98 - rng.random(), 100 + rng.random(), 10 + i) for i in range(n)]
    assert indicators.features(bars(spark, rows)).count() == kept


def test_flat_prices_give_no_infinity(spark):
    out = indicators.window_indicators(bars(spark, [("A", i, 5, 5, 5, 5, 0) for i in range(30)]))
    assert out.where("stoch_k is not null or bb_percentage is not null").count() == 0


def test_dedup_keeps_largest_volume_and_reruns_agree(spark):
    b = bars(spark, [("A", 0, 1, 1, 1, 1, 5), ("A", 0, 2, 2, 2, 2, 9), ("A", 0, 3, 3, 3, 3, 9)])
    assert [r.close for r in warehouse.dedup(b).collect()] == [3.0]


def test_upsert_keeps_the_new_row(spark):
    old, new = bars(spark, [("A", 0, 1, 1, 1, 1, 5), ("A", 1, 1, 1, 1, 1, 5)]), bars(spark, [("A", 1, 7, 7, 7, 7, 1)])
    assert sorted(r.close for r in warehouse.upsert(old, new, ("asset_symbol", "date")).collect()) == [1.0, 7.0]


def test_facts_are_loaded_once(spark):
    b = bars(spark, [("AUSDT", i, 1, 1, 1, 1, 1) for i in range(3)])
    dims = warehouse.dim_assets(b, "Crypto"), warehouse.dim_date(spark), warehouse.dim_interval(spark)
    have = warehouse.load_facts(b, *dims)
    assert have.count() == 3 and warehouse.load_facts(b, *dims, have).count() == 0


def test_macro_table_joins_the_third_series_by_the_first(spark):
    s = lambda ds: spark.createDataFrame([(datetime(2024, 1, d), 1.0) for d in ds], "date timestamp_ntz, close double")
    assert warehouse.macro_table(s([1]), s([2]), s([2])).count() == 3


def test_folds_drift_to_the_shortest_month():
    starts = [f[0] for f in modelling.folds(datetime(2023, 1, 31, 5), datetime(2024, 6, 1))]
    assert starts[:3] == [datetime(2023, 1, 31, 5), datetime(2023, 2, 28, 5), datetime(2023, 3, 28, 5)]


def test_folds_and_pivot_take_every_asset(spark, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    late = lines.where("l_shipdate > '1995-07-01'").withColumn("l_returnflag", F.lit("X"))
    lines.unionByName(late).write.parquet(f"{tmp_path}/lineitem.parquet")
    b = catalog.bars_1d(spark, str(tmp_path)).select("asset_symbol", "date", "close").toPandas()
    want = {}
    for symbol, dates in b.groupby("asset_symbol")["date"]:
        kept = 0
        for lo, mid, hi in modelling.folds(dates.min().to_pydatetime(), dates.max().to_pydatetime()):
            train, test = int(((dates >= lo) & (dates < mid)).sum()), int(((dates >= mid) & (dates < hi)).sum())
            if train >= 100 and test >= 20:
                kept += 1
                want[symbol, kept] = (test, train)
    got = {(r.asset_symbol, r.fold_id): (r.n_test, r.n_train) for r in catalog.QUERIES["backtest_folds"](spark, str(tmp_path)).collect()}
    assert got == want and {s for s, _ in got} == {"A", "N", "R", "X"}
    pivoted = catalog.QUERIES["pivot_closes"](spark, str(tmp_path)).toPandas().set_index("date")
    assert set(pivoted.columns) == {"A", "N", "R", "X"}
    assert all(pivoted.loc[d, s] == c for s, d, c in b.itertuples(index=False))


def test_intervals_of_one_symbol_stay_apart(spark):
    hourly = bars(spark, [("A", i, 1, 1, 1, 1 + i, 5) for i in range(3)])
    both = hourly.unionByName(hourly.withColumn("interval", F.lit("1d")))
    assert warehouse.dedup(both).count() == 6
    assert indicators.window_indicators(both).where("returns_1p is null").count() == 2


def test_new_assets_follow_the_largest_key(spark):
    old = warehouse.dim_assets(bars(spark, [("B", 0, 1, 1, 1, 1, 1)]))
    got = warehouse.dim_assets(bars(spark, [("A", 0, 1, 1, 1, 1, 1), ("B", 0, 1, 1, 1, 1, 1)]), have=old)
    assert sorted((r.asset_id, r.asset_symbol) for r in got.collect()) == [(1, "B"), (2, "A")]


def test_standardise_fits_each_group_on_its_own(spark):
    b = bars(spark, [("A", i, 1, 1, 1, 1 + i, 1) for i in range(4)] + [("B", i, 1, 1, 1, 100, 1) for i in range(4)])
    got = modelling.standardise(b.withColumn("is_train", F.hour("date") < 2), ["close"])
    assert sorted(r.close for r in got.where("asset_symbol = 'A'").collect()) == [-1.0, 1.0, 3.0, 5.0]
    assert {r.close for r in got.where("asset_symbol = 'B'").collect()} == {0.0}


def test_markdown_report(spark):
    assert sinks.markdown_table(spark.createDataFrame([(1, "a")], "n int, s string")) == "| n | s |\n|---|---|\n| 1 | a |"


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"stats_importance"}


def test_importances_find_what_makes_the_target(spark):
    df = spark.range(1500).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("log_returns")).withColumn("returns_1p", F.col("a") * 2 + F.col("b") * 0.01)
    got = {r.feature_name: r.importance_score for r in statistics.importances(df, ["a", "b", "log_returns"]).collect()}
    assert got["a"] > 0.9 > 0.1 > got["b"] > got["log_returns"] == 0
    assert {r.importance_score for r in statistics.importances(df.limit(10), ["a", "b"]).collect()} == {0.0}


def test_audit_columns_and_object_store(spark):
    once = warehouse.with_audit(spark.range(1))
    first = once.withColumn("created_at", F.lit(datetime(2020, 1, 1)))
    assert warehouse.with_audit(first).first().created_at == datetime(2020, 1, 1) and once.first().updated_at.year >= 2024
    assert object_store("http://h:9000", "k", "s")["spark.hadoop.fs.s3a.path.style.access"] == "true"
