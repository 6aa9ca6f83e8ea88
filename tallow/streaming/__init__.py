"""Candles from a stream of prints: event-time windows with a watermark, written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events under a path as a stream of (asset_symbol, ts, value), a schema known beforehand."""
    now = spark.read.parquet(path)
    stream = spark.readStream.schema(now.schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    # A stream reads folders: a single file is the one of that name in its folder.
    stream = stream.option("pathGlobFilter", name).parquet(folder) if [x.rpartition("/")[2] for x in now.inputFiles()] == [name] else stream.parquet(path)
    return stream.select(F.col("event_type").alias("asset_symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")


def stream_candles(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Candles by event time; one is final, and given out, once the watermark has passed its end."""
    w = events.withWatermark("ts", late).groupBy("asset_symbol", F.window("ts", width).alias("w"))
    c = w.agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume"))
    return c.select("asset_symbol", F.col("w.start").cast("timestamp_ntz").alias("date"), "open", "high", "low", "close", "volume")


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is there now into a Parquet table (exactly once: its checkpoint lies beside it) and read that."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")


def without_duplicates(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of events with equal keys that come within the watermark's delay of one another; events behind the watermark are left out (and counted, see drain_counted)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drain_counted(stream: DataFrame, path: str) -> tuple[DataFrame, dict[str, int]]:
    """As drain(), with the rows that its stateful steps took in, and those that came behind the watermark and were dropped."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    steps = [s for p in query.recentProgress for s in p["stateOperators"]]
    counts = {"added": sum(s["numRowsUpdated"] for s in steps), "late": sum(s["numRowsDroppedByWatermark"] for s in steps)}
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table"), counts
