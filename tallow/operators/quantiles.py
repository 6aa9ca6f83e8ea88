"""Exact quantiles by distributed selection: no task sorts or holds a group's values.

A quantile lies between two neighbouring ranks. Each pass counts what lies below and inside the range that holds them and
cuts the range by a sketch of its values; the next pass keeps the cuts around the ranks, with room for the sketch's error.
When a range holds few values, or only equal ones, its values are counted and the ranks are read off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallow.operators.series import meet
from tallow.sources.stages import stage

FEW = 65_536  # values that a range may hold to be counted one by one
CUTS = 512  # parts of a range in each pass
ACCURACY = 20_000  # of the sketch: errors are far below a part
PASSES = 12


def exact_quantiles(df: DataFrame, cols: list[str], probs: tuple[float, ...], by: tuple[str, ...] = (), few: int = FEW) -> DataFrame:
    """by, feature (of cols), p, quantile: interpolated between the ranks around p (n - 1), as percentile() does.

    Nulls are left out, NaN is the largest value. A column without values in a group has no rows.
    """
    feature = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols]))
    long = df.select(*by, feature.alias("f")).select(*by, "f.feature", "f.x").where("x IS NOT NULL")
    keys = (*by, "feature")
    # p (n - 1) for all p of a group, from one count.
    sizes = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    p = F.explode(F.array(*[F.lit(float(x)) for x in probs]))
    ranges = sizes.select(*keys, "n", "lo", "hi", p.alias("p")).withColumns({"at": F.col("p") * (F.col("n") - 1), "below": F.lit(0).cast("long"), "inside": F.col("n")})
    ranges = stage(ranges, "quantile-ranges")
    for _ in range(PASSES):
        wide = (F.col("inside") > few) & (F.col("lo") < F.col("hi"))
        if not ranges.where(wide).limit(1).count():
            break
        ranges = stage(_narrowed(long, ranges.where(wide), keys).unionByName(ranges.where(~wide)), "quantile-ranges")
    inside = _within(long, ranges, keys).groupBy(*keys, "p", "at", "below", "x").agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*keys, "p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    rank = lambda r: F.min(F.when(F.col("upto") > r, F.col("x")))
    found = inside.withColumn("upto", upto).groupBy(*keys, "p", "at").agg(rank(F.floor("at")).alias("a"), rank(F.ceil("at")).alias("b"))
    share = F.col("at") - F.floor("at")
    return found.select(*keys, "p", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b")).alias("quantile"))


def _within(long: DataFrame, ranges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each value once for every range of its group that it lies in."""
    both = meet(long, ranges.select(*keys, "p", "at", "below", "lo", "hi"), keys, "inner")
    return both.where(F.col("x").between(F.col("lo"), F.col("hi")))


def _narrowed(long: DataFrame, ranges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """ranges cut down to the parts around their ranks, with what lies below and inside them counted."""
    grid = F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)])
    cut = _within(long, ranges, keys).groupBy(*keys, "p").agg(F.percentile_approx("x", grid, F.lit(ACCURACY)).alias("cuts"))
    old = meet(ranges, cut, (*keys, "p"), "inner")
    place = lambda rank: (rank - F.col("below")) / F.col("inside") * CUTS
    first, last = F.floor(place(F.floor("at"))) - 1, F.ceil(place(F.ceil("at") + 1)) + 1
    cut_at = lambda i: F.element_at("cuts", (i + 1).cast("int"))
    edge = lambda ok, i, otherwise: F.when(ok, cut_at(F.least(F.greatest(i, F.lit(0)), F.lit(CUTS)))).otherwise(F.col(otherwise))
    new = stage(old.withColumns({"_lo": edge(first > 0, first, "lo"), "_hi": edge(last < CUTS, last, "hi")}).drop("cuts"), "quantile-cuts")
    seen = meet(long, new.select(*keys, "p", "_lo", "_hi"), keys, "inner")
    counts = seen.groupBy(*keys, "p").agg(F.count_if(F.col("x") < F.col("_lo")).alias("_below"), F.count_if(F.col("x").between(F.col("_lo"), F.col("_hi"))).alias("_inside"))
    out = meet(new, counts, (*keys, "p"), "inner")
    # The sketch's bound says that this holds; where it did not, the range stays.
    holds = (F.col("_below") <= F.floor("at")) & (F.ceil("at") < F.col("_below") + F.col("_inside"))
    take = lambda a, b: F.when(holds, F.col(a)).otherwise(F.col(b))
    return out.withColumns({"lo": take("_lo", "lo"), "hi": take("_hi", "hi"), "below": take("_below", "below"), "inside": take("_inside", "inside")}).drop("_lo", "_hi", "_below", "_inside")


def as_columns(quantiles: DataFrame, names: dict[float, str], by: tuple[str, ...] = ()) -> DataFrame:
    """One row per by and feature, a column per quantile."""
    pick: list[Column] = [F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name) for p, name in names.items()]
    return quantiles.groupBy(*by, "feature").agg(*pick)
