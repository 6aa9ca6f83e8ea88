"""What has to work at any size, on small tables and against plain pandas."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallow.functions.windows import ordered
from tallow.operators import drawdown, matrices, profile, quantiles, warehouse
from tallow.plans.runner import Run, Step, StepFailed, input_version
from tallow.sources.tables import create_table, drop_table

T0 = datetime(2024, 1, 1)
CANDLES = "asset_symbol string, interval string, date timestamp_ntz, close double, volume double, asset_class string"


def candles(spark, rows):
    """(symbol, interval, date, close[, class])"""
    return spark.createDataFrame([(s, i, d, float(c) if c is not None else None, 1.0, *(k or ["Stock"])) for s, i, d, c, *k in rows], CANDLES)


# Exact quantiles


@pytest.mark.parametrize("few", [4, 60, 65_536])
def test_quantiles_are_those_of_percentile(spark, few, monkeypatch):
    monkeypatch.setattr(quantiles, "CUTS", 16)
    rng = np.random.default_rng(3)
    rows = [("ties", float(rng.integers(0, 4))) for _ in range(900)] + [("skew", float(np.exp(rng.normal(0, 9)))) for _ in range(700)] + [("one", 7.0)] * 300
    rows += [("half", 5.0)] * 400 + [("half", float(x)) for x in rng.normal(5, 1e-6, 400)] + [("few", 1.0), ("few", None), ("few", 4.0)] + [("none", None)] * 3 + [(None, 2.5)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = (0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0)
    got = {(r.g, r.p): r.quantile for r in quantiles.exact_quantiles(df, ["x"], probs, ("g",), few=few).collect()}
    want = {(r.g, p): q for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, probs))).alias("q")).where("q IS NOT NULL").collect() for p, q in zip(probs, r.q, strict=True)}
    assert got.keys() == want.keys() and len(got) == 7 * 6
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-300) for k in want)


def test_quantiles_of_several_columns_and_of_nothing(spark):
    df = spark.range(1001).select(F.col("id").cast("int").alias("a"), (-F.col("id")).cast("double").alias("b"))
    got = quantiles.as_columns(quantiles.exact_quantiles(df, ["a", "b"], (0.25, 0.5), few=10), {0.25: "q25", 0.5: "q50"})
    assert sorted(map(tuple, got.collect())) == [("a", 250.0, 500.0), ("b", -750.0, -500.0)]
    assert quantiles.exact_quantiles(df.where("false"), ["a"], (0.5,)).count() == 0


# Correlations by blocks


def test_correlations_by_blocks_with_missing_dates(spark):
    rng = np.random.default_rng(1)
    wide = pd.DataFrame(rng.normal(1000, 3, (90, 23)).cumsum(axis=0), columns=[f"s{i:02d}" for i in range(23)])
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    wide["s22"] = np.where(np.arange(90) < 2, 1.0, np.nan)
    wide["s21"] = np.where(wide["s21"].isna(), np.nan, 8.25)
    long = wide.stack().reset_index().set_axis(["d", "name", "v"], axis=1)
    df = spark.createDataFrame(long).withColumn("date", F.timestamp_seconds(F.col("d") * 86400).cast("timestamp_ntz")).repartition(4)
    got = matrices.pair_sums(df, "name", "date", "v", block=5, run_dates=7).toPandas().set_index(["a", "b"])
    pairs = [(a, b) for i, a in enumerate(wide) for b in list(wide)[i + 1 :]]
    for a, b in pairs:
        both = wide[[a, b]].dropna()
        if len(both):
            row = got.loc[(a, b)]
            assert row.n == len(both)
            want = both[a].corr(both[b]) if both.nunique().min() > 1 else np.nan
            assert np.isclose(row.correlation, want, rtol=1e-9, atol=1e-10, equal_nan=True), (a, b)
    assert len(got) == sum(len(wide[[a, b]].dropna()) > 0 for a, b in pairs)


# As-of alignment


@pytest.mark.parametrize("width", [None, 3_600_000_000, 17_000_000, 10**15])
def test_asof_over_buckets(spark, width):
    rng = np.random.default_rng(2)
    # One symbol over 50 hours; prints stop for days, so that many buckets have none.
    bars = [("A", "1h", T0 + timedelta(minutes=int(m)), 1) for m in sorted(rng.choice(3000, 400, replace=False))] + [("B", "1h", T0, 1)]
    prints = sorted({int(m) for m in [*rng.integers(300, 500, 20), *rng.integers(2500, 2600, 9)]})
    aux = spark.createDataFrame([("A", T0 + timedelta(minutes=m), float(m)) for m in prints] + [("A", T0 + timedelta(minutes=2700), None)], "asset_symbol string, date timestamp_ntz, rate double")
    got = {(r.asset_symbol, r.date): r.rate for r in warehouse.align_asof(candles(spark, bars), aux, "rate", width=width).collect()}
    assert len(got) == len(bars)
    for s, _, d, _ in bars:
        known = [m for m in prints if T0 + timedelta(minutes=m) <= d] if s == "A" else []
        assert got[s, d] == (float(known[-1]) if known else None)


def test_ffill_over_buckets(spark):
    bars = candles(spark, [("A", "1h", T0 + timedelta(hours=i), 1) for i in range(200)])
    aux = spark.createDataFrame([("A", "1h", T0 + timedelta(hours=h), v) for h, v in ((3, 1.5), (90, None), (91, 2.5))], "asset_symbol string, interval string, date timestamp_ntz, rate double")
    got = warehouse.align_exact_ffill(bars, aux, "rate", width=4 * 3_600_000_000).orderBy("date").toPandas()["rate"]
    assert got[:3].isna().all() and (got[3:91] == 1.5).all() and (got[91:] == 2.5).all()


# Gaps


def plain_gaps(dates, freq):
    ideal = pd.date_range(min(dates), max(dates), freq=freq)
    return len(dates), len(set(ideal) - set(dates)), round(len(dates) / len(ideal) * 100, 6)


@pytest.mark.parametrize("code,kind,freq", [("1h", "Stock", "h"), ("1d", "Stock", "B"), ("1d", "Crypto", "D"), ("4h", "Crypto", "D"), ("1wk", "Stock", "7D"), ("1mo", "Stock", "ME"), ("M", "Crypto", "ME")])
def test_gap_scan_against_made_timelines(spark, code, kind, freq):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k in range(14):
        start = T0 + timedelta(days=k, hours=6)
        ideal = list(pd.date_range(start, periods=40 + k, freq=freq))
        dates = sorted({*[d.to_pydatetime() for i, d in enumerate(ideal) if i in (0, len(ideal) - 1) or rng.random() < 0.7], ideal[3].to_pydatetime() + timedelta(minutes=7)})
        rows += [(f"s{k}", code, d, 1, kind) for d in dates]
        want[f"s{k}"] = plain_gaps(dates, freq)
    got = {r.asset_symbol: (r.n_rows, r.gap_count, r.completeness) for r in profile.gap_scan(candles(spark, rows)).collect()}
    assert got == want


def test_missing_candles_are_made_in_gaps_alone(spark):
    hours = [0, 1, 2, 5, 5.5, 9, 10, 10]
    rows = [("A", "1h", T0 + timedelta(hours=h), 1) for h in hours] + [("B", "1h", T0, 1)]
    got = sorted(r.date for r in profile.missing_candles(candles(spark, rows), "1 HOUR").collect())
    assert got == [T0 + timedelta(hours=h) for h in (3, 4, 6, 7, 8)]


def test_islands(spark):
    rows = [("A", "1h", T0 + timedelta(hours=h), 1) for h in (0, 1, 2, 6, 7, 20)]
    got = [tuple(r)[2:] for r in profile.islands(candles(spark, rows), 3600).orderBy("island").collect()]
    at = lambda h: T0 + timedelta(hours=h)
    assert got == [(1, at(0), at(2), 3, 4 * 3600), (2, at(6), at(7), 2, 13 * 3600), (3, at(20), at(20), 1, None)]


# Two intervals of one symbol


def test_profilers_keep_intervals_apart(spark):
    rng = np.random.default_rng(6)
    rows = [("A", "1h", T0 + timedelta(hours=i), 5) for i in range(10)] + [("A", "1d", T0 + timedelta(days=i), 5 + rng.random()) for i in range(60)]
    b = candles(spark, rows).withColumns({c: F.col("close") for c in ("open", "high", "low")})
    assert {(r.interval, r.dead) for r in profile.dead_assets(b).collect()} == {("1h", True), ("1d", False)}
    assert {(r.interval, r.n) for r in profile.downsample(b, 5).groupBy("interval").agg(F.count("*").alias("n")).collect()} == {("1h", 5), ("1d", 5)}
    both = profile.downsample(b, 5).where("interval = '1h'").collect()
    assert {r.close for r in both} == {5.0} and sum(r.volume for r in both) == 10
    alone = b.where("interval = '1d'")
    for f in (profile.last_zscore, profile.volatility_scan, profile.squeeze, profile.ma_cross):
        got = f(b)
        assert "interval" in got.columns
        assert got.where("interval = '1d'").collect() == f(alone).collect()


# Tables and runs


def test_bucketed_table_needs_no_exchange(spark):
    b = candles(spark, [(s, "1h", T0 + timedelta(hours=i), i) for s in "ABC" for i in range(50)])
    t = create_table(b, "bars_in_buckets", ("asset_symbol", "interval"), ("date",), buckets=4)
    w = ordered().rowsBetween(-6, 0)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    out = t.withColumn("sma_7", F.avg("close").over(w))
    assert "Exchange" not in plan(out) and "Exchange" in plan(b.withColumn("sma_7", F.avg("close").over(w)))
    assert "Exchange" not in plan(t.groupBy("asset_symbol", "interval").count())
    assert out.count() == 150 and out.where("date = '2024-01-01 10:00:00'").first().sma_7 == 7.0
    # IF NOT EXISTS keeps it, CREATE OR REPLACE doesn't, DROP IF EXISTS can be repeated.
    assert create_table(b.limit(1), "bars_in_buckets", if_not_exists=True).count() == 150
    assert create_table(b.limit(1), "bars_in_buckets").count() == 1
    for _ in range(2):
        drop_table(spark, "bars_in_buckets")
    assert not spark.catalog.tableExists("bars_in_buckets")


def test_runs_resume_retry_and_start_over(spark, tmp_path):
    calls, broken = [], {"b": 1, "c": 2}

    def step(name, after=(), retries=0):
        def build(s, tables):
            calls.append(name)
            if broken.get(name, 0) > 0:
                broken[name] -= 1
                raise OSError(f"no {name}")
            rows = sum(t.count() for t in tables.values()) + 1
            return s.range(rows)

        return Step(name, build, after, retries)

    steps = [step("a"), step("b", ("a",), retries=1), step("c", ("b",)), step("d", ("a", "c"))]
    run = Run(spark, str(tmp_path / "run"), steps)
    with pytest.raises(StepFailed, match="c: OSError: no c"):
        run.run({"in": "1"})
    assert calls == ["a", "b", "b", "c"] and run.manifest()["b"]["attempts"] == 2 and run.manifest()["c"]["outcome"] == "failed"
    calls.clear()
    with pytest.raises(StepFailed):
        run.run({"in": "1"})
    # Another process goes on from the manifest.
    assert Run(spark, str(tmp_path / "run"), steps).run({"in": "1"}) == ["c", "d"] and calls == ["c", "c", "d"]
    assert run.table("d").count() == 1 + 1 + 3
    assert run.run({"in": "1"}) == []
    assert run.run({"in": "2"}) == ["a", "b", "c", "d"]
    assert run.run({"in": "2"}, force=True) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        Run(spark, str(tmp_path), [step("x", ("y",))])


def test_input_versions_follow_the_files(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(3).write.parquet(path)
    one = input_version(spark, path)
    assert input_version(spark, path) == one
    spark.range(3).write.mode("append").parquet(path)
    assert input_version(spark, path) != one


def test_price_ids_are_dense_and_go_on(spark):
    b = candles(spark, [(s, "1h", T0 + timedelta(hours=i), 1) for s in ("B", "AUSDT") for i in range(30)]).withColumns({c: F.col("close") for c in ("open", "high", "low")})
    dims = warehouse.dim_assets(b), warehouse.calendar_of(b), warehouse.dim_interval(spark)
    first = warehouse.with_price_ids(warehouse.load_facts(b.where(F.hour("date") < 5), *dims))
    rest = warehouse.with_price_ids(warehouse.load_facts(b, *dims, first), first)
    ids = [r.price_id for r in first.unionByName(rest).orderBy("price_id").collect()]
    assert ids == list(range(1, 61))


def test_calendar_begins_with_the_first_fact(spark):
    b = candles(spark, [("A", "1d", datetime(1971, 3, 4), 1), ("A", "1d", datetime(2031, 3, 4), 1)]).withColumns({c: F.col("close") for c in ("open", "high", "low")})
    dates = warehouse.calendar_of(b)
    assert dates.agg(F.min("date")).first()[0].isoformat() == "1971-03-04" and dates.agg(F.max("date")).first()[0].year == 2036
    assert warehouse.load_facts(b, warehouse.dim_assets(b), dates, warehouse.dim_interval(spark)).count() == 2


# Drawdowns


def test_drawdowns_over_pieces(spark):
    rng = np.random.default_rng(9)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 333)))
    b = candles(spark, [("A", "1d", T0 + timedelta(days=i), c) for i, c in enumerate(close)] + [("A", "1d", T0 - timedelta(days=1), None)])
    got = drawdown.drawdowns(b, size=40).orderBy("date").toPandas()
    peak = pd.Series(close).cummax()
    assert np.allclose(got.peak, peak) and np.allclose(got.drawdown, close / peak - 1)


def test_market_index_over_pieces(spark):
    rng = np.random.default_rng(10)
    wide = pd.DataFrame(100 * np.exp(rng.normal(0, 0.02, (200, 4)).cumsum(axis=0)))
    rows = [(f"s{k}", "1d", T0 + timedelta(days=i), wide.loc[i, k]) for k in wide for i in wide.index if k < 3 or i > 50]
    got = drawdown.market_index(candles(spark, rows), size=30).orderBy("date").toPandas()
    wide.loc[:50, 3] = np.nan
    r = np.log(wide).diff().mean(axis=1).dropna()
    total = r.cumsum()
    assert np.allclose(got.log_return, r) and np.allclose(got.cumulative, total)
    assert np.allclose(got.drawdown, np.exp(total - total.cummax().clip(lower=0)) - 1)
