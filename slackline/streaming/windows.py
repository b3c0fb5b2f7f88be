"""Windowed aggregations with watermarks over a stream of observations (ts, key, value).

Each function works on a streaming and on a batch frame alike; run_available() reads a folder as
a stream to its end and returns the result as a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "2 hours"


def tumbling(events: DataFrame, key: str, value: str, size: str = "1 hour") -> DataFrame:
    windows = events.withWatermark("ts", LATE).groupBy(F.window("ts", size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))
    return windows.select(F.col("window.start").alias("start"), key, "n", "total", "most")


def sliding(events: DataFrame, key: str, value: str, size: str = "3 hours", step: str = "1 hour") -> DataFrame:
    windows = events.withWatermark("ts", LATE).groupBy(F.window("ts", size, step), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))
    return windows.select(F.col("window.start").alias("start"), key, "n", "total", "most")


def sessions(events: DataFrame, key: str, value: str, gap: str = "45 minutes") -> DataFrame:
    windows = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return windows.select(F.col("session_window.start").alias("start"), key, "n", "total")


def first_reports(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row of those that repeat the keys within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys)


def meetings(left: DataFrame, right: DataFrame, key: str, within: str = "45 minutes") -> DataFrame:
    """Stream-stream interval join: right rows of the same key up to so long after a left row."""
    a = left.withWatermark("ts", LATE).select(F.col("ts").alias("a_ts"), F.col(key).alias("a_key"), F.col("event_id").alias("a_id"))
    b = right.withWatermark("ts", LATE).select(F.col("ts").alias("b_ts"), F.col(key).alias("b_key"), F.col("event_id").alias("b_id"))
    return a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("b_ts") > F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {within}")))


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, written to ``out`` as Parquet by the streaming sink, exactly once, and read again."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run ``work`` on each micro-batch of what is there; a batch may come again after a failure, so it must be idempotent."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
