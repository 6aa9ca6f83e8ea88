"""State over a stream against the batch columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallow.operators import indicators
from tallow.streaming import drain
from tallow.streaming.series import NO_IDLE_BATCHES, ROCKS, stream_indicators


def walk(symbol, n, seed):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return pd.DataFrame({"asset_symbol": symbol, "interval": "1h", "date": pd.date_range("2024-01-01", periods=n, freq="h"), "high": close * 1.01, "low": close * 0.99, "close": close})


@pytest.fixture
def rocks(spark):
    settings = ROCKS | NO_IDLE_BATCHES
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def put(spark, pdf, folder):
    spark.createDataFrame(pdf).withColumn("date", F.col("date").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, ttl_ms=None):
    return stream_indicators(spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder), ttl_ms=ttl_ms)


def test_stream_equals_batch_after_a_restart(rocks, tmp_path):
    spark, folder, out = rocks, str(tmp_path / "candles"), str(tmp_path / "out")
    all_rows = pd.concat([walk("A", 260, 1), walk("B", 40, 2)], ignore_index=True)
    cut = pd.Timestamp("2024-01-01") + pd.Timedelta(hours=20)
    put(spark, all_rows[all_rows.date < cut].sample(frac=1, random_state=1), folder)
    drain(stream(spark, folder), out)
    # The query has ended; a new one goes on from the checkpoint. Old, repeated and empty candles are left out.
    put(spark, all_rows[all_rows.date >= cut - pd.Timedelta(hours=3)], folder)
    put(spark, all_rows[all_rows.asset_symbol == "B"].assign(close=np.nan, date=pd.Timestamp("2030-01-01")).head(1), folder)
    got = drain(stream(spark, folder), out).toPandas().sort_values(["asset_symbol", "date"])
    assert len(got) == 300 and not got.duplicated(["asset_symbol", "date"]).any()
    for symbol, rows in all_rows.groupby("asset_symbol"):
        want, mine = indicators.recursive_columns(rows), got[got.asset_symbol == symbol]
        for c in indicators.RECURSIVE:
            assert np.allclose(mine[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True), c


def test_state_expires(rocks, tmp_path):
    spark, folder, out = rocks, str(tmp_path / "candles"), str(tmp_path / "out")
    rows = walk("A", 60, 3)
    put(spark, rows.head(30), folder)
    drain(stream(spark, folder, ttl_ms=1), out)
    put(spark, rows.tail(30), folder)
    got = drain(stream(spark, folder, ttl_ms=1), out).toPandas().sort_values("date")
    late = indicators.recursive_columns(rows.tail(30).reset_index(drop=True))
    assert np.allclose(got.tail(30)["ema_26"].to_numpy(float), late["ema_26"].to_numpy(float), equal_nan=True)
    assert got.tail(30)["ema_26"].isna().sum() == 25
