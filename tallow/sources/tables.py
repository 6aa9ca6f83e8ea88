"""Catalog tables: built from a frame, bucketed and sorted by the keys of joins and windows, dropped, made if not there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallow.sources.stages import scratch_path


def create_table(df: DataFrame, name: str, by: tuple[str, ...] = (), order: tuple[str, ...] = (), buckets: int = 16, if_not_exists: bool = False) -> DataFrame:
    """CREATE OR REPLACE TABLE name AS df (or CREATE IF NOT EXISTS), in `buckets` buckets by the columns `by`, sorted by them and `order` within.

    Rows are dealt by bucket before they are written, so a bucket is one file, and windows, groupings and joins by these columns read
    it without an exchange. The files lie in the shared folder.
    """
    spark = df.sparkSession
    if if_not_exists and spark.catalog.tableExists(name):
        return spark.table(name)
    drop_table(spark, name)
    writer = df.repartition(buckets, *by) if by else df
    writer = writer.write.format("parquet").option("path", scratch_path(spark, name.rpartition(".")[2]))
    if by:
        writer = writer.bucketBy(buckets, *by).sortBy(*by, *order)
    writer.saveAsTable(name)
    return spark.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """DROP TABLE IF EXISTS; the files of the shared folder stay for readers that still have them."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
