"""Statistics of feature tables: one aggregation each, then rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.functions.windows import BY, ordered
from tallow.operators.quantiles import as_columns, exact_quantiles

# Columns that hold the return to be told.
LEAKAGE = ["returns_1p", "returns_5p", "returns_10p", "returns_20p", "log_returns"]


def correlations(df: DataFrame, cols: list[str], places: int = 6) -> DataFrame:
    """Pearson correlation of every pair of columns (in their order): feature_1, feature_2, correlation. One aggregation over the rows; each pair takes the rows where both are known."""
    pairs = list(combinations(cols, 2))
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.round(F.corr(a, b), places).alias("correlation")) for a, b in pairs]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


def high_correlations(df: DataFrame, cols: list[str], least: float = 0.9) -> DataFrame:
    return correlations(df, cols).where(F.abs("correlation") > least)


def ranked(df: DataFrame, cols: list[str], by: tuple[str, ...]) -> DataFrame:
    """cols as average ranks within each group (ties share the mean of their places)."""
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(c).over(Window.partitionBy(*by, c)) - 1) / 2
    return df.select(*by, *[F.when(F.col(c).isNotNull(), rank(c)).alias(c) for c in cols])


def spearman(df: DataFrame, cols: list[str], by: tuple[str, ...] = BY) -> DataFrame:
    """Rank correlation of every pair of columns in each group."""
    pairs = list(combinations(cols, 2))
    r = ranked(df.na.drop(subset=cols), cols, by)
    one = r.groupBy(*by).agg(F.array(*[F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.round(F.corr(a, b), 6).alias("correlation")) for a, b in pairs]).alias("x"))
    return one.select(*by, F.explode("x").alias("x")).select(*by, "x.*")


def autocorrelation(df: DataFrame, col: str, lags: int = 50, first: int = 1000, by: tuple[str, ...] = BY) -> DataFrame:
    """Autocorrelation at lags 0 to `lags` over the first rows of each group: one window pass, one aggregation."""
    w = ordered(by)
    x = df.where(F.col(col).isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= first)
    x = x.withColumn("_x", F.col(col) - F.avg(col).over(Window.partitionBy(*by)))
    x = x.withColumns({f"_p{k}": F.col("_x") * F.lead("_x", k).over(w) for k in range(lags + 1)})
    g = x.groupBy(*by).agg(F.array(*[F.struct(F.lit(k).alias("lag"), F.sum(f"_p{k}").alias("s")) for k in range(lags + 1)]).alias("a"))
    return g.select(*by, F.explode("a").alias("e"), F.col("a")[0]["s"].alias("c0")).select(*by, "e.lag", F.round(F.try_divide(F.col("e.s"), F.col("c0")), 6).alias("autocorrelation"))


def histogram(df: DataFrame, col: str, bins: int = 40, by: tuple[str, ...] = BY) -> DataFrame:
    """Counts of equal-width bins between each group's least and largest value; the last bin is closed."""
    known = df.where(F.col(col).isNotNull())
    span = known.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    at = F.least(F.floor(F.try_divide((F.col(col) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    return known.join(span, list(by)).withColumn("bin", F.coalesce(at, F.lit(0)).cast("long")).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count and share of each value."""
    g = df.groupBy(*by, col).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))), 6))


def missing_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns with missing values, most first."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = one.unpivot("_n", cols, "feature", "null_count").where("null_count > 0")
    return rows.select("feature", "null_count", F.round(F.col("null_count") / F.col("_n") * 100, 6).alias("null_pct")).orderBy(F.desc("null_count"), "feature")


def feature_statistics(df: DataFrame, cols: list[str], target: str = "returns_1p") -> DataFrame:
    """describe() of each feature with has_inf, null_count, correlation with the target and quality flag (FAIL_INF, FAIL_NULL, LEAKAGE, PASS).

    The columns become rows once; quantiles are exact, over the rows of a feature.
    """
    inf = lambda c: F.col(c).isin(float("inf"), float("-inf"))
    long = df.select(F.col(target).alias("_t"), F.array(*[F.struct(F.lit(c).alias("feature_name"), F.col(c).cast("double").alias("x")) for c in cols]).alias("f")).select("_t", F.explode("f").alias("f")).select("_t", "f.*")
    g = long.groupBy("feature_name").agg(
        F.count("x").alias("count"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("std"), F.round(F.min("x"), 4).alias("min"), F.round(F.max("x"), 4).alias("max"),
        (F.count_if(inf("x")) > 0).alias("has_inf"), F.count_if(F.col("x").isNull()).alias("null_count"), F.round(F.corr("x", "_t"), 6).alias("target_correlation"),
    )
    quartiles = as_columns(exact_quantiles(df, cols, (0.25, 0.5, 0.75)), {0.25: "q25", 0.5: "q50", 0.75: "q75"})
    g = g.join(quartiles.select(F.col("feature").alias("feature_name"), *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q75")]), "feature_name", "left")
    g = g.select("feature_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max", "has_inf", "null_count", "target_correlation")
    flag = F.when(F.col("has_inf"), "FAIL_INF").when(F.col("null_count") > 0, "FAIL_NULL").when(F.col("feature_name").isin(*LEAKAGE), "LEAKAGE").otherwise("PASS")
    return g.withColumn("quality_flag", flag).withColumn("target_correlation", F.when(F.col("feature_name") != target, F.col("target_correlation")))


def top_features(statistics: DataFrame, n: int = 15) -> DataFrame:
    """The n features without fault or leakage that follow the target most."""
    return statistics.where("quality_flag = 'PASS'").orderBy(F.desc(F.abs("target_correlation")), "feature_name").limit(n).select("feature_name", "target_correlation")


def importances(df: DataFrame, cols: list[str], target: str = "returns_1p", sample: int = 10_000, least: int = 1000, seed: int = 42) -> DataFrame:
    """Importance of each feature for the target by a random forest: feature_name, importance_score, one row per feature; leakage columns score 0.

    The forest learns from at most `sample` rows with all values known, those with the smallest hash of their
    values; with fewer than `least` rows all scores are 0.
    """
    used = [c for c in cols if c not in LEAKAGE and c != target]
    known = df.select(F.col(target).alias("_target"), *used).na.drop()
    rows = known.orderBy(F.xxhash64("_target", *used)).limit(sample).persist()
    scores = dict.fromkeys(cols, 0.0)
    if rows.count() >= least:
        ready = VectorAssembler(inputCols=used, outputCol="_features").transform(rows)
        forest = RandomForestRegressor(featuresCol="_features", labelCol="_target", numTrees=50, maxDepth=10, seed=seed).fit(ready)
        scores |= dict(zip(used, map(float, forest.featureImportances.toArray()), strict=True))
    rows.unpersist()
    return df.sparkSession.createDataFrame(list(scores.items()), "feature_name string, importance_score double")
