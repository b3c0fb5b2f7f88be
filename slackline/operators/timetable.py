"""Timetables: stops, sequences of stop times and the connections between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackline.functions.cleaning import line_label, sound_edge, stop_number, with_prefix
from slackline.functions.clock import clock_seconds


def build_stops(platforms: DataFrame) -> DataFrame:
    """stop, name, lat and lon: platforms (stop_id, stop_name, stop_lat, stop_lon) of one numeric id are one stop."""
    rows = platforms.withColumn("stop", stop_number(F.col("stop_id"))).filter("stop is not null")
    return rows.groupBy("stop").agg(F.max("stop_name").alias("name"), F.avg("stop_lat").alias("lat"), F.avg("stop_lon").alias("lon"))


def build_footpaths(walks: DataFrame, stops: DataFrame) -> DataFrame:
    """Walks (a, b, ...) between known stops."""
    known = stops.select("stop").distinct()
    first = walks.join(known.withColumnRenamed("stop", "a"), "a", "left_semi")
    return first.join(known.withColumnRenamed("stop", "b"), "b", "left_semi")


def full_table(stop_times: DataFrame, stops: DataFrame, trips: DataFrame, calendar: DataFrame, routes: DataFrame) -> DataFrame:
    """Stop times of known stops with their trip, its service days and, where there is one, its route."""
    rows = stop_times.join(stops.select("stop").distinct(), "stop").join(trips, "trip_id").join(calendar, "service_id").join(routes, "route_id", "left")
    return rows.withColumn("line_text", line_label(F.col("route_short_name"), F.col("trip_short_name"), F.col("route_id"))).withColumn("operator_id", with_prefix(F.col("agency_id")))


def build_connections(stop_times: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """dep_stop, arr_stop, dep_secs, arr_secs, trip_id and dep_seq, and carried columns of the departure.

    The next stop is the next one of the trip that there is, so a gap left by a region's border is
    bridged. All three look-aheads share one window, keyed by trip, which bounds a group.
    """
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    ahead = stop_times.select("*", F.lead("stop").over(w).alias("arr_stop"), F.lead("arr_secs").over(w).alias("_next"))
    edges = ahead.select("trip_id", F.col("stop").alias("dep_stop"), "arr_stop", F.col("arr_secs").alias("dep_secs"), F.col("_next").alias("arr_secs"), F.col("stop_sequence").alias("dep_seq"), *carry)
    return edges.filter("arr_stop is not null").filter(sound_edge(F.col("dep_secs"), F.col("arr_secs"), F.col("dep_stop"), F.col("arr_stop")))


def connections_by_join(stop_times: DataFrame) -> DataFrame:
    """The older form: each stop joined to the one whose sequence number is one more."""
    b = stop_times.select("trip_id", F.col("stop").alias("arr_stop"), F.col("arr_secs").alias("_arr"), (F.col("stop_sequence") - 1).alias("stop_sequence"))
    return stop_times.join(b, ["trip_id", "stop_sequence"]).select("trip_id", F.col("stop").alias("dep_stop"), "arr_stop", F.col("arr_secs").alias("dep_secs"), F.col("_arr").alias("arr_secs"), F.col("stop_sequence").alias("dep_seq"))


def with_clocks(rows: DataFrame, **columns: str) -> DataFrame:
    """New columns of seconds from columns of clock text."""
    return rows.withColumns({new: clock_seconds(F.col(old)) for new, old in columns.items()})


def validate(connections: DataFrame, keys: tuple[str, ...] = ("trip_id", "dep_seq")) -> DataFrame:
    """One row: connections, missing times, backward times, loops, repeated keys."""
    keyed = connections.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.count_if(c).alias(n) for n, c in {
        "null_times": F.col("dep_secs").isNull() | F.col("arr_secs").isNull(), "negative_times": F.col("arr_secs") < F.col("dep_secs"), "loops": F.col("dep_stop") == F.col("arr_stop")}.items()])
    return keyed.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("connections"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("null_times", "negative_times", "loops")], F.count_if(F.col("_n") > 1).alias("repeated"))


def busyness(connections: DataFrame) -> DataFrame:
    """stop, uses and tier: how often a stop is an end of a connection; the 30 busiest are hubs, 150 major."""
    uses = connections.select(F.explode(F.array("dep_stop", "arr_stop")).alias("stop")).groupBy("stop").agg(F.count("*").alias("uses"))
    rank = F.row_number().over(Window.orderBy(F.desc("uses"), "stop"))  # one row a stop
    return uses.withColumn("place", rank).withColumn("tier", F.when(F.col("place") <= 30, "hub").when(F.col("place") <= 150, "major").otherwise("minor"))


def walk_degree(walks: DataFrame) -> DataFrame:
    return walks.groupBy(F.col("a").alias("stop")).agg(F.count("*").alias("neighbours"))
