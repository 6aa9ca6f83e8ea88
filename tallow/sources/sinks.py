"""Sinks and loads that can be run again: partitioned Parquet, JSON, append, insert-or-ignore, upsert, small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.operators.warehouse import upsert
from tallow.sources.stages import scratch_path  # noqa: F401


def write_partitioned(df: DataFrame, path: str, keys: tuple[str, ...] = ("asset_symbol", "interval")) -> None:
    """Parquet sink, one folder per key, rows in time order within files."""
    keys = [k for k in keys if k in df.columns]
    df.repartition(*keys).sortWithinPartitions(*keys, "date").write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def insert_new(df: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """Append the rows whose key the stored table lacks."""
    have = df.sparkSession.read.parquet(path)
    append(df.join(have.select(*keys), list(keys), "left_anti").select(*have.columns), path)


def upsert_into(df: DataFrame, path: str, keys: tuple[str, ...], to: str) -> None:
    """The stored table with df's rows in place of those of equal keys, as a new version at `to`: the old one stays readable meanwhile."""
    upsert(df.sparkSession.read.parquet(path), df, keys).write.mode("overwrite").parquet(to)


def markdown_table(df: DataFrame, rows: int = 50) -> str:
    """The first rows of a small report as a Markdown table."""
    lines = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(lines + [f"| {' | '.join(str(x) for x in r)} |" for r in df.limit(rows).collect()])


def markdown_lines(report: DataFrame, title: str, order: tuple[str, ...]) -> DataFrame:
    """A report as Markdown lines: section, line_no and line: a heading, the header of a table and its rows in `order`. For reports; one task numbers the rows."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = report.select((F.row_number().over(Window.orderBy(*order)) + 3).cast("long").alias("line_no"), row.alias("line"))
    head = [f"## {title}", f"| {' | '.join(report.columns)} |", f"|{'---|' * len(report.columns)}"]
    heads = report.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(head)], "line_no long, line string")
    return heads.unionByName(rows).select(F.lit(title).alias("section"), "line_no", "line")


def klines_of(bars: DataFrame) -> DataFrame:
    """Bars as the JSON pages of the exchange's API (body), one page per symbol and day: arrays of text, newest first."""
    ms = F.unix_millis(F.col("date").cast("timestamp")).cast("string")
    line = F.array(ms, *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume", "turnover")])
    pages = bars.groupBy("asset_symbol", F.to_date("date").alias("day")).agg(F.sort_array(F.collect_list(F.struct(F.col("date"), line.alias("l"))), asc=False).alias("x"))
    return pages.select("asset_symbol", F.to_json(F.struct(F.struct(F.transform("x", lambda r: r["l"]).alias("list")).alias("result"))).alias("body"))
