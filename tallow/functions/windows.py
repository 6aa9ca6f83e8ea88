"""Window building blocks over ordered groups."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

BY = ("asset_symbol", "interval")


def ordered(by: tuple[str, ...] = BY, order: str = "date"):
    return Window.partitionBy(*by).orderBy(order)


def rolling(fn, col: Column | str, n: int, w, full: bool = True) -> Column:
    """fn over the last n rows; with full, NULL until n non-null values are there."""
    c = F.col(col) if isinstance(col, str) else col
    frame = w.rowsBetween(-(n - 1), 0)
    value = fn(c).over(frame)
    return F.when(F.count(c).over(frame) == n, value) if full else value


def lagged(col: str, w, n: int = 1) -> Column:
    return F.lag(col, n).over(w)


def pct_change(col: str, w, n: int = 1) -> Column:
    return F.try_divide(F.col(col), F.lag(col, n).over(w)) - 1


def ffill(col: str, w) -> Column:
    return F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def guarded(d: Column, instead: float) -> Column:
    """A denominator with its zeros replaced."""
    return F.when(d == 0, F.lit(instead)).otherwise(d)


def ieee_ratio(x: Column, y: Column) -> Column:
    """x / y of doubles as SQL engines with IEEE arithmetic give it: infinite over 0, NaN for 0 over 0, NULL for NULL alone."""
    over_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, over_zero).otherwise(F.try_divide(x, y))


def ieee_ln(x: Column) -> Column:
    """Natural logarithm, minus infinite at 0 and NaN below; NULL for NULL alone."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log(x))
