"""Correlations of many series by blocks: no row meets another row of its date in a join.

Dates are cut into runs and assets into blocks; what a run has of a block is one matrix, dates by assets, with NaN where a
candle is missing. Products of two matrices give the sums that the correlations of their assets need, over the dates
that both have. The sums of all runs are added up in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.operators.series import meet, numbered
from tallow.sources.stages import stage

BLOCK = 512  # assets of a block
RUN = 256  # dates of a run
SALTS = 16
_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _number(df: DataFrame, col: str) -> DataFrame:
    """col and its number from 0, of the distinct values of a column: ranges of values are numbered where they lie."""
    out = numbered(df.select(col, F.lit(0).alias("_one")).where(F.col(col).isNotNull()).distinct(), ("_one",), col)
    return out.select(col, (F.col("row_no") - 1).alias(f"_{col}"))


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The sums of all rows with equal keys."""

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
        total = None
        for pdf in frames if not isinstance(frames, pd.DataFrame) else [frames]:
            for s in pdf["sums"]:
                x = np.frombuffer(s)
                total = x.copy() if total is None else total + x
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "sums": [total.tobytes()]})

    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} long" for k in keys) + ", sums binary")


def pair_sums(series: DataFrame, name: str, date: str, value: str, block: int = BLOCK, run_dates: int = RUN) -> DataFrame:
    """a, b (a before b by name), n and correlation of every two series with common dates; series has one value per name and date."""
    known = series.select(name, date, F.col(value).cast("double").alias("_v")).where(F.col(name).isNotNull() & F.col(date).isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v"))
    # Values less their series' mean: correlations stay, sums lose no digits.
    known = stage(known, "matrix-values")
    known = meet(known, stage(known.groupBy(name).agg(F.avg("_v").alias("_mean")), "matrix-means"), (name,), "inner").withColumn("_v", F.col("_v") - F.col("_mean")).drop("_mean")
    assets = stage(_number(known, name), "matrix-assets")
    block = min(block, max(1, assets.count()))
    known = meet(meet(known, assets, (name,), "inner"), stage(_number(known, date), "matrix-dates"), (date,), "inner")
    at = known.select((F.col(f"_{name}") / block).cast("long").alias("block"), (F.col(f"_{date}") / run_dates).cast("long").alias("run"), (F.col(f"_{name}") % block).cast("int").alias("i"), (F.col(f"_{date}") % run_dates).cast("int").alias("t"), "_v")

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.full((run_dates, block), np.nan)
        m[pdf["t"], pdf["i"]] = pdf["_v"]
        return pd.DataFrame({"block": [key[0]], "run": [key[1]], "m": [m.tobytes()]})

    made = stage(at.groupBy("block", "run").applyInPandas(fill, "block long, run long, m binary"), "matrix-blocks")
    left, right = made.select("run", F.col("block").alias("p"), F.col("m").alias("l")), made.select("run", F.col("block").alias("q"), F.col("m").alias("r"))

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for run, p, q, lm, rm in zip(pdf["run"], pdf["p"], pdf["q"], pdf["l"], pdf["r"], strict=True):
                a, b = (np.frombuffer(x).reshape(run_dates, block) for x in (lm, rm))
                ka, kb = ((~np.isnan(x)).astype(float) for x in (a, b))
                a, b = np.nan_to_num(a), np.nan_to_num(b)
                sums = np.stack((ka.T @ kb, a.T @ kb, ka.T @ b, (a * a).T @ kb, ka.T @ (b * b), a.T @ b))
                yield pd.DataFrame({"p": [p], "q": [q], "salt": [run % SALTS], "sums": [sums.tobytes()]})

    with_pairs = left.join(right, "run").where("p <= q").mapInPandas(products, "p long, q long, salt long, sums binary")
    total = _added(_added(with_pairs, ["p", "q", "salt"]).drop("salt"), ["p", "q"])

    def figures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p, q, s in zip(pdf["p"], pdf["q"], pdf["sums"], strict=True):
                n, x, y, xx, yy, xy = np.frombuffer(s).reshape(len(_SUMS), block, block)
                i, j = np.nonzero(n if p < q else np.triu(n, 1))
                n, x, y, xx, yy, xy = (v[i, j] for v in (n, x, y, xx, yy, xy))
                with np.errstate(divide="ignore", invalid="ignore"):
                    c = (xy - x * y / n) / np.sqrt((xx - x * x / n) * (yy - y * y / n))
                yield pd.DataFrame({"i": p * block + i, "j": q * block + j, "n": n.astype(np.int64), "c": c})

    found = total.mapInPandas(figures, "i long, j long, n long, c double")
    side = lambda new, place: assets.select(F.col(name).alias(new), F.col(f"_{name}").alias(place))
    return meet(meet(found, side("a", "i"), ("i",), "inner"), side("b", "j"), ("j",), "inner").select("a", "b", "n", F.when(~F.isnan("c"), F.col("c")).alias("correlation"))
