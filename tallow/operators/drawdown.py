"""Cumulative returns, running peaks and drawdowns by prefix scans: no window over a whole series, or over one of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.functions.windows import BY, ordered
from tallow.operators.series import ROWS, Running, numbered, pieces, scan


def drawdowns(levels: DataFrame, col: str = "close", by: tuple[str, ...] = BY, size: int = ROWS) -> DataFrame:
    """levels with peak (the largest col so far) and drawdown (col over peak, less 1); rows without a level are left out."""
    known = levels.where(F.col(col).isNotNull() & ~F.isnan(col)).drop("peak", "drawdown")
    done = scan(pieces(numbered(known, by), 0, size), {"peak": Running("max", col)}, by, size=size)
    return done.withColumn("drawdown", F.try_divide(col, "peak") - 1).drop("row_no", "n_rows", "piece", "in_halo")


def market_index(bars: DataFrame, by: tuple[str, ...] = ("interval",), size: int = ROWS) -> DataFrame:
    """by, date, assets, log_return, cumulative, peak and drawdown of an index: the mean log return of all assets with a candle and one before it.

    cumulative is the sum of the log returns so far, peak its largest value (at least 0, where the index starts), drawdown exp(cumulative - peak) - 1.
    """
    key = ("asset_symbol", *by)
    p = pieces(numbered(bars.select(*key, "date", "close").where("close > 0"), key), 1, size)
    before = F.lag("close").over(ordered((*key, "piece"), "row_no"))
    r = p.withColumn("r", F.log(F.col("close") / before)).where("NOT in_halo AND r IS NOT NULL")
    index = r.groupBy(*by, "date").agg(F.count("*").alias("assets"), F.avg("r").alias("log_return"))
    done = scan(pieces(numbered(index, by), 0, size), {"cumulative": Running("sum", "log_return")}, by, size=size)
    done = scan(done, {"peak": Running("max", "cumulative")}, by, size=size).withColumn("peak", F.greatest("peak", F.lit(0.0)))
    return done.select(*by, "date", "assets", "log_return", "cumulative", "peak", (F.exp(F.col("cumulative") - F.col("peak")) - 1).alias("drawdown"))

