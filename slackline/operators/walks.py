"""Walking: a graph from tagged ways, stops snapped to it, and bounded shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.functions.geo import EARTH_KM, haversine, pairs_within

# Kinds of ways.
WALKABLE = (
    "footway", "pedestrian", "path", "steps", "crossing", "living_street", "residential", "service", "track",
    "cycleway", "unclassified", "tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link", "road",
)
MOTOR = ("motorway", "motorway_link", "trunk", "trunk_link")


def walk_graph(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges (a, b, metres), both ways, of ways (highway, foot, refs) that one may walk; motor roads only with foot=yes."""
    may = (F.coalesce("foot", F.lit("")) != "no") & (F.col("highway").isin(*WALKABLE) | (F.col("highway").isin(*MOTOR) & (F.col("foot") == "yes")))
    steps = ways.filter(may).select(F.inline(F.arrays_zip(F.slice("refs", F.lit(1), F.size("refs") - 1).alias("a"), F.slice("refs", F.lit(2), F.size("refs") - 1).alias("b"))))
    at = lambda c: nodes.select(F.col("node").alias(c), F.col("lat").alias(f"{c}_lat"), F.col("lon").alias(f"{c}_lon"))
    edges = steps.join(at("a"), "a").join(at("b"), "b").withColumn("metres", haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"), EARTH_KM * 1000))
    both = edges.select("a", "b", "metres").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "metres"))
    return both.filter("a <> b").groupBy("a", "b").agg(F.min("metres").alias("metres"))


def snap(stops: DataFrame, nodes: DataFrame, metres: float = 500.0) -> DataFrame:
    """(stop, node): the nearest node within reach, in degrees; the smaller node of equal ones. Both sides meet by grid cells."""
    size = metres / 111_000.0
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    n = nodes.select("node", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).withColumn("cy", F.floor(F.col("_lat") / size)).withColumn("cx", F.floor(F.col("_lon") / size))
    s = stops.withColumn("dy", around).withColumn("dx", around).withColumn("cy", F.floor(F.col("lat") / size) + F.col("dy")).withColumn("cx", F.floor(F.col("lon") / size) + F.col("dx"))
    d = F.pow(F.col("lat") - F.col("_lat"), 2) + F.pow(F.col("lon") - F.col("_lon"), 2)
    return s.join(n, ["cx", "cy"]).withColumn("d", d).groupBy("stop").agg(F.min_by("node", F.struct("d", "node")).alias("node"))


def shortest_within(edges: DataFrame, sources: DataFrame, cutoff: float, checkpoint=lambda df, k: df, most_rounds: int = 200) -> DataFrame:
    """(source, node, metres) of all nodes within the cutoff of a source.

    The frontier, pairs whose distance has just become shorter, is joined to the edges; the best of
    old and new distances stays. checkpoint(df, round) writes a round's table and returns it read
    again, which cuts the lineage; it is called each round. Ends when no distance becomes shorter.
    """
    best = checkpoint(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("metres"), F.lit(0).alias("round")), 0)
    for k in range(1, most_rounds):
        frontier = best.filter(F.col("round") == k - 1)
        reached = frontier.join(edges, frontier["node"] == edges["a"]).select("source", F.col("b").alias("node"), (frontier["metres"] + edges["metres"]).alias("metres"), F.lit(k).alias("round"))
        merged = best.unionByName(reached.filter(F.col("metres") <= cutoff)).groupBy("source", "node").agg(F.min(F.struct("metres", "round")).alias("m"))
        best = checkpoint(merged.select("source", "node", "m.metres", "m.round"), k)
        if best.filter(F.col("round") == k).isEmpty():
            return best.drop("round")
    raise RuntimeError(f"distances didn't settle in {most_rounds} rounds")


def footpaths(edges: DataFrame, snapped: DataFrame, max_walk: float = 500.0, metres_per_minute: float = 50.0, base_minutes: float = 2.0, checkpoint=lambda df, k: df) -> DataFrame:
    """(a, b, distance, walk_time_min) between different stops whose walk is at most ``max_walk``; the search goes on to 1.5 times that."""
    sources = snapped.select(F.col("node").alias("source")).distinct()
    near = shortest_within(edges, sources, 1.5 * max_walk, checkpoint).filter(F.col("metres") <= max_walk)
    from_ = snapped.select(F.col("stop").alias("a"), F.col("node").alias("source"))
    to = snapped.select(F.col("stop").alias("b"), "node")
    paths = near.join(from_, "source").join(to, "node").filter("a <> b")
    return paths.select("a", "b", F.col("metres").alias("distance"), (base_minutes + F.col("metres") / metres_per_minute).alias("walk_time_min"))


def straight_footpaths(stops: DataFrame, max_walk: float = 500.0, metres_per_minute: float = 50.0, base_minutes: float = 2.0) -> DataFrame:
    """The older form: great-circle walks between stops near each other."""
    pairs = pairs_within(stops, "stop", max_walk)
    return pairs.select("a", "b", F.col("metres").alias("distance"), (base_minutes + F.col("metres") / metres_per_minute).alias("walk_time_min"))


def straight_between_places(stops: DataFrame, max_walk: float = 500.0, metres_per_minute: float = 50.0, base_minutes: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """straight_footpaths() with the stops of one point as one place, named by the smallest: (stop, place) of stops that have a point,
    and (a, b, distance, walk_time_min) between places; a place's walk to itself is between its stops. Many stops at few points have
    far fewer walks this way."""
    points = stops.filter("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min("stop").alias("place"))
    own = points.select(F.col("place").alias("a"), F.col("place").alias("b"), F.lit(0.0).alias("distance"), F.lit(base_minutes).alias("walk_time_min"))
    return stops.join(points, ["lat", "lon"]).select("stop", "place"), straight_footpaths(points.withColumnRenamed("place", "stop"), max_walk, metres_per_minute, base_minutes).unionByName(own)


def too_short(walks: DataFrame, stops: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Walks shorter than the straight line between their ends: none, if the graph is right."""
    at = lambda c: stops.select(F.col("stop").alias(c), F.col("lat").alias(f"{c}_lat"), F.col("lon").alias(f"{c}_lon"))
    line = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"), EARTH_KM * 1000)
    return walks.join(at("a"), "a").join(at("b"), "b").withColumn("line", line).filter(F.col("line") > F.col("distance") + tolerance)
