"""Stored tables in the roles of the domain: observations of stops, timetables, stops with places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.sources.tables import read


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """events as observed stops: a trip is a user's day, the stop the number in props, the delay the value."""
    e = read(spark, folder, "events")
    ts = F.col("ts").cast("timestamp")
    day = F.to_date(ts)
    return e.select(
        "event_id", ts.alias("ts"), F.date_trunc("second", ts).alias("arr_time"), F.unix_timestamp(ts).alias("secs"), day.alias("operating_day"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.dayofmonth(day).cast("string")).alias("trip_id"), "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("bpuic"), F.col("event_type").alias("transport"), F.col("value").alias("delay"),
        F.hour(ts).alias("hour"), F.dayofweek(day).alias("dow"), F.month(day).alias("month"),
    )


#: observations() in SQL.
OBSERVATIONS = """obs AS (SELECT event_id, ts, date_trunc('second', ts) AS arr_time, epoch(date_trunc('second', ts))::BIGINT AS secs, CAST(ts AS DATE) AS operating_day,
  user_id || '-' || day(ts) AS trip_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS bpuic, event_type AS transport, value AS delay,
  CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) + 1 AS INTEGER) AS dow, CAST(month(ts) AS INTEGER) AS month FROM events)"""


def stop_times(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as a timetable: a trip is an order, its stops are suppliers in the order of ship date.
    Clocks start at an hour that the order's number gives and go on for eight minutes a stop."""
    li = read(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity")
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    seq = F.row_number().over(w)
    start = (F.col("l_orderkey") % 26) * 3600 + (F.col("l_orderkey") % 60) * 60
    return li.withColumn("stop_sequence", seq).select(
        F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").cast("int").alias("stop"), "stop_sequence", (start + (F.col("stop_sequence") - 1) * 480).cast("int").alias("arr_secs"), F.col("l_quantity").alias("quantity"),
    )


STOP_TIMES = """st0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS stop_sequence FROM lineitem),
st AS (SELECT l_orderkey AS trip_id, CAST(l_suppkey AS INTEGER) AS stop, CAST(stop_sequence AS INTEGER) AS stop_sequence,
  CAST((l_orderkey % 26) * 3600 + (l_orderkey % 60) * 60 + (stop_sequence - 1) * 480 AS INTEGER) AS arr_secs, l_quantity AS quantity FROM st0)"""


def stops(spark: SparkSession, folder: str) -> DataFrame:
    """supplier as stops, placed by integer arithmetic on the key."""
    k = F.col("s_suppkey")
    return read(spark, folder, "supplier").select(k.cast("int").alias("stop"), F.col("s_name").alias("name"), "s_nationkey", (F.lit(46.0) + (k * 37 % 100) / 100.0).alias("lat"), (F.lit(6.0) + (k * 61 % 300) / 100.0).alias("lon"))


STOPS = "stops AS (SELECT CAST(s_suppkey AS INTEGER) AS stop, s_name AS name, s_nationkey, 46.0::DOUBLE + (s_suppkey * 37 % 100) / 100.0::DOUBLE AS lat, 6.0::DOUBLE + (s_suppkey * 61 % 300) / 100.0::DOUBLE AS lon FROM supplier)"


def stations(spark: SparkSession) -> DataFrame:
    """Ten weather stations on a diagonal."""
    return spark.range(10).select(F.col("id").cast("int").alias("station"), (F.lit(46.05) + F.col("id") / 10.0).alias("lat"), (F.lit(6.1) + F.col("id") * 0.3).alias("lon"))


STATIONS = "stations AS (SELECT CAST(i AS INTEGER) AS station, 46.05::DOUBLE + i / 10.0::DOUBLE AS lat, 6.1::DOUBLE + i * 0.3::DOUBLE AS lon FROM range(10) t(i))"
