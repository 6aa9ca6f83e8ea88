"""Long series in pieces, against the same series in memory."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallow.operators import indicators
from tallow.operators.series import Ewm, Running, numbered, pieces, scan

COLUMNS = ["open", "high", "low", "close", "volume"]


def walk(n, seed=0, symbol="A"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    high, low = close * (1 + rng.random(n) * 0.01), close * (1 - rng.random(n) * 0.01)
    return pd.DataFrame({"asset_symbol": symbol, "interval": "1h", "date": pd.date_range("2000-01-01", periods=n, freq="min"), "open": close, "high": high, "low": low, "close": close, "volume": rng.integers(0, 90, n).astype(float)})


def frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("date", F.col("date").cast("timestamp_ntz")).repartition(7)


@pytest.mark.parametrize("size", [200, 211, 700, 65_536])
def test_recursions_over_pieces_are_those_in_memory(spark, size):
    parts = [walk(1500, 1, "A"), walk(200, 2, "B"), walk(5, 3, "C"), walk(601, 4, "D")]
    got = indicators.recursive_indicators(frame(spark, pd.concat(parts)), size=size).toPandas()
    for p in parts:
        want = indicators.recursive_columns(p)
        mine = got[got.asset_symbol == p.asset_symbol[0]].sort_values("date")
        assert len(mine) == len(want)
        for c in indicators.RECURSIVE:
            assert np.allclose(mine[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True), (c, size)


def test_features_over_pieces_are_those_of_one(spark):
    bars = frame(spark, pd.concat([walk(1200, 5, "A"), walk(199, 6, "B")]))
    cols = indicators.RECURSIVE + indicators.WINDOWED + indicators.PREVIOUS
    one, many = (indicators.features(bars, size=s).toPandas().sort_values("date") for s in (65_536, 200))
    assert len(one) == len(many) == 1001 and set(one.asset_symbol) == {"A"}
    assert np.allclose(one[cols].to_numpy(float), many[cols].to_numpy(float), rtol=1e-9, atol=1e-7)


def test_one_series_of_two_million_rows_in_64_pieces(spark):
    n = 2_000_000
    # A series that Spark and numpy make alike: products of sines.
    at = np.arange(n, dtype=float)
    close = 100 + 10 * np.sin(at / 97) + 3 * np.sin(at * 1.7)
    rows = spark.range(n).select(F.lit("A").alias("asset_symbol"), F.lit("1m").alias("interval"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("date"), F.col("id"))
    c = 100 + 10 * F.sin(F.col("id") / 97) + 3 * F.sin(F.col("id") * 1.7)
    bars = rows.select("asset_symbol", "interval", "date", "id", (c + 1).alias("high"), (c - 1).alias("low"), c.alias("close"))
    out = indicators.recursive_indicators(bars, size=n // 64)
    want = indicators.recursive_columns(pd.DataFrame({"close": close, "high": close + 1, "low": close - 1}))
    got = out.where("id % 997 = 0 OR id % 31250 < 40").select("id", *indicators.RECURSIVE).toPandas().set_index("id").sort_index()
    assert len(got) > 4000
    for x in indicators.RECURSIVE:
        assert np.allclose(got[x].to_numpy(float), want[x].to_numpy(float)[got.index], rtol=1e-9, atol=1e-9, equal_nan=True), x


def test_rows_without_a_price_take_no_part(spark):
    p = walk(300, 7)
    p["close"] = p["close"].where(p.index % 50 != 3)
    got = indicators.recursive_indicators(frame(spark, p), size=200).toPandas().sort_values("date", ignore_index=True)
    gone = p["close"].isna()
    assert len(got) == 300 and got.loc[gone, "ema_12"].isna().all()
    want = indicators.recursive_columns(p[~gone].reset_index(drop=True))
    assert np.allclose(got.loc[~gone, "macd_signal"].to_numpy(float), want["macd_signal"], rtol=1e-9, equal_nan=True)


def test_row_numbers_and_halos(spark):
    bars = frame(spark, pd.concat([walk(95, 1, "A"), walk(10, 2, None)]))
    n = numbered(bars).toPandas().sort_values(["asset_symbol", "date"])
    assert n.row_no.tolist() == [*range(1, 96), *range(1, 11)] and set(n.n_rows) == {95, 10}
    p = pieces(numbered(bars), 25, 10).where("asset_symbol = 'A'").toPandas()
    for k, g in p.groupby("piece"):
        assert sorted(g.row_no[~g.in_halo]) == list(range(10 * k + 1, min(10 * k + 10, 95) + 1))
        assert sorted(g.row_no[g.in_halo]) == list(range(max(1, 10 * k - 24), 10 * k + 1))
    assert numbered(bars.where("false")).count() == 0
    assert indicators.recursive_indicators(bars.where("false")).count() == 0


def test_running_figures_meet_over_pieces(spark):
    p = walk(500, 9)
    rows = pieces(numbered(frame(spark, p)), 3, 64)
    done = scan(rows, {"total": Running("sum", "volume"), "peak": Running("max", "close"), "low_yet": Running("min", "close"), "mean": Ewm(0.3, "close")}, size=64)
    got = done.where("NOT in_halo").toPandas().sort_values("row_no")
    assert np.allclose(got.total, p.volume.cumsum()) and (got.peak.to_numpy() == p.close.cummax().to_numpy()).all()
    assert (got.low_yet.to_numpy() == p.close.cummin().to_numpy()).all() and np.allclose(got["mean"], p.close.ewm(alpha=0.3, adjust=False).mean())


def test_dashboard_means_over_pieces(spark):
    p = walk(450, 11)
    got = indicators.dashboard_recursive(frame(spark, p), size=100).toPandas().sort_values("date")
    ema = {n: p.close.ewm(span=n, adjust=False).mean() for n in (9, 12, 21, 26, 50)}
    macd = ema[12] - ema[26]
    assert np.allclose(got.ema_dash_21, ema[21], rtol=1e-10) and np.allclose(got.macd_dash_signal, macd.ewm(alpha=0.2, adjust=False).mean(), rtol=1e-8, atol=1e-9)
    assert isinstance(got.date.iloc[0], datetime)
