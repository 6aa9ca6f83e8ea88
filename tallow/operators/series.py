"""Long series in pieces: row numbers, pieces with rows of the piece before, and recursions as an associative scan.

No task holds a whole series. Rows are dealt to ranges of (series, time) and numbered by their place in the range plus the
counts of the ranges before it. Equal runs of rows are pieces. A recursion is solved in each piece as if nothing had come
before; its effect on what comes in is an affine map, so the maps of the pieces, a row each, are composed in order and
their result is added to the piece's rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tallow.functions.windows import BY
from tallow.sources.stages import stage

ROWS = 65_536
SMALL = 100_000  # rows of a table that is sent to every task; a larger one is joined


@dataclass(frozen=True)
class Ewm:
    """y = (1 - alpha) y' + alpha x; y is x itself at the first known x, from row `start` on.

    x is a column, or the difference of two other recursions of the same scan (a pair of their names).
    """

    alpha: float
    source: str | tuple[str, str]
    start: int = 1


@dataclass(frozen=True)
class Running:
    """The running sum, max or min of a column."""

    kind: str
    source: str


def meet(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "left") -> DataFrame:
    """left with right's row of the same keys (null meets null); right is sent to every task if it has at most SMALL rows."""
    other = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    if right.count() <= SMALL:
        other = F.broadcast(other)
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(other[f"_of_{k}"])
    return left.join(other, on, how).drop(*[f"_of_{k}" for k in keys])


def numbered(df: DataFrame, by: tuple[str, ...] = BY, order: str | tuple[str, ...] = "date") -> DataFrame:
    """df with row_no (from 1, by `order` within each series) and n_rows of its series. Ties keep one order, as the dealt rows are stored."""
    keys = (*by, *((order,) if isinstance(order, str) else order))
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    held = stage(dealt, "series").withColumn("_range", F.shiftright("_at", 33))
    parts = held.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    before = F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    parts = stage(parts.select(*by, "_range", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("n_rows")), "series-parts")
    out = meet(held, parts, (*by, "_range"))
    return out.withColumn("row_no", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_range", "_first", "_before")


def pieces(rows: DataFrame, halo: int, size: int = ROWS) -> DataFrame:
    """Numbered rows with piece (from 0) and in_halo: each piece also has the `halo` rows before it, so that windows of that length see them."""
    own = F.expr(f"(row_no - 1) div {size}")
    last = F.least(F.expr(f"(row_no + {halo} - 1) div {size}"), F.expr(f"(n_rows - 1) div {size}"))
    dealt = rows.withColumn("_own", own).withColumn("piece", F.explode(F.sequence("_own", last)))
    return dealt.withColumn("in_halo", F.col("piece") > F.col("_own")).drop("_own")


def _ewm(x: np.ndarray, alpha: float) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def _local(pdf: pd.DataFrame, ewms: dict[str, Ewm]) -> dict[str, np.ndarray]:
    """Each recursion over the rows of a piece in order: the first piece's as it is, a later one's as if 0 had come before."""
    first, out = int(pdf["piece"].iloc[0]) == 0 if len(pdf) else True, {}
    for name, r in ewms.items():
        x = pdf[r.source].to_numpy(float) if isinstance(r.source, str) else out[r.source[0]] - out[r.source[1]]
        if first and r.start > 1:
            x = np.where(pdf["row_no"].to_numpy() < r.start, np.nan, x)
        y = _ewm(x, r.alpha)
        out[name] = y if first or not len(x) else y - (1 - r.alpha) ** np.arange(1, len(x) + 1) * x[0]
    return out


def _decay(r: Ewm, k: Column | float) -> Column | float:
    return F.pow(F.lit(1 - r.alpha), k) if isinstance(k, Column) else (1 - r.alpha) ** k


def _carried(name: str, recursions: dict[str, Ewm | Running], local, carry, k):
    """A recursion's value k rows into a piece, of its local value and what came in; for columns and for numbers."""
    r = recursions[name]
    if isinstance(r, Running):
        both = (local(name), carry(name))
        if r.kind == "sum":
            return both[0] + both[1]
        if isinstance(both[0], Column):
            return (F.greatest if r.kind == "max" else F.least)(*both)
        return (max if r.kind == "max" else min)(*both)
    value = local(name) + _decay(r, k) * carry(name)
    if not isinstance(r.source, str):
        for sign, other in zip((1, -1), r.source, strict=True):
            keep = 1 - recursions[other].alpha
            told = r.alpha * keep / (keep - (1 - r.alpha)) * (_decay(recursions[other], k) - _decay(r, k))
            value = value + sign * told * carry(other)
    return value


def scan(rows: DataFrame, recursions: dict[str, Ewm | Running], by: tuple[str, ...] = BY, order: str = "date", size: int = ROWS) -> DataFrame:
    """rows (of pieces()) with a column per recursion; rows in a halo have null there. Sources are known in every row; the pieces are of `size` rows."""
    ewms = {n: r for n, r in recursions.items() if isinstance(r, Ewm)}
    running = {n: r for n, r in recursions.items() if isinstance(r, Running)}
    out = rows
    if running:
        w = Window.partitionBy(*by, "piece").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
        fns = {"sum": F.sum, "max": F.max, "min": F.min}
        out = out.withColumns({n: F.when(~F.col("in_halo"), fns[r.kind](F.when(~F.col("in_halo"), F.col(r.source))).over(w)) for n, r in running.items()})
    if ewms:
        names = out.columns
        schema = StructType([*out.schema.fields, *[StructField(n, DoubleType()) for n in ewms]])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("row_no", kind="stable", ignore_index=True)
            own = ~pdf["in_halo"].to_numpy(bool)
            for n, y in _local(pdf[own], ewms).items():
                pdf[n] = np.nan
                pdf.loc[own, n] = y
            return pdf[[*names, *ewms]]

        out = out.groupBy(*by, "piece").applyInPandas(run, schema)
        out = out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in ewms})
    held = stage(out, "scan")
    if not held.where("piece > 0").limit(1).count():
        return held
    ends = held.where(~F.col("in_halo") & (F.col("row_no") % size == 0)).select(*by, "piece", *recursions)
    carry = StructType([*ends.schema[: len(by)], StructField("piece", LongType()), *[StructField(f"_in_{n}", DoubleType()) for n in recursions]])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        """One series, a row per full piece: what each next piece gets."""
        pdf = pdf.sort_values("piece", ignore_index=True)
        local = {n: pdf[n].to_numpy(float) for n in recursions}
        got = {n: np.empty(len(pdf)) for n in recursions}
        for i in range(len(pdf)):
            for n in recursions:
                got[n][i] = local[n][0] if i == 0 else _carried(n, recursions, lambda m: local[m][i], lambda m: got[m][i - 1], size)
        return pd.DataFrame({**{c: pdf[c] for c in by}, "piece": pdf["piece"] + 1, **{f"_in_{n}": x for n, x in got.items()}})

    told = stage(ends.groupBy(*by).applyInPandas(compose, carry), "scan-carry")
    joined = meet(held, told, (*by, "piece"))
    k = (F.col("row_no") - F.col("piece") * size).cast("double")
    late = F.col("piece") > 0
    return joined.withColumns({n: F.when(late, _carried(n, recursions, lambda m: F.col(m), lambda m: F.col(f"_in_{m}"), k)).otherwise(F.col(n)) for n in recursions}).drop(*[f"_in_{n}" for n in recursions])
