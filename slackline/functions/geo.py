"""Distances and areas as column expressions, and nearest neighbours by grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the radius' unit."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring, an array of (x, y) whose last point joins the first: an odd number of edges crosses its ray."""
    n = F.size(ring)

    def crosses(p, i):
        q = F.get(ring, (i + 1) % n)
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"])

    return F.aggregate(F.transform(ring, crosses), F.lit(False), lambda odd, hit: odd != F.coalesce(hit, F.lit(False)))


def assign_areas(points: DataFrame, areas: DataFrame, point: str, area: str) -> DataFrame:
    """(point, area) pairs for points (x, y) in areas (ring). Boxes of one degree are the equi-join
    key, so that only areas near a point are tested."""
    low = lambda c: F.floor(F.array_min(F.transform("ring", lambda p: p[c]))).cast("int")
    high = lambda c: F.floor(F.array_max(F.transform("ring", lambda p: p[c]))).cast("int")
    cells = areas.withColumn("cx", F.explode(F.sequence(low("x"), high("x")))).withColumn("cy", F.explode(F.sequence(low("y"), high("y"))))
    placed = points.withColumn("cx", F.floor("x").cast("int")).withColumn("cy", F.floor("y").cast("int"))
    return placed.join(cells, ["cx", "cy"]).filter(inside(F.col("x"), F.col("y"), F.col("ring"))).select(point, area).distinct()


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """For each left (lat, lon) the nearest right one and the distance in km; equal distances go to the smaller id.

    The right side is a reference table (stations); Spark broadcasts it by its own size check. For
    tables too large for that use pairs_within(), whose key is a grid cell.
    """
    r = right.select(F.col(right_id).alias("_r"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    pairs = left.filter("lat is not null and lon is not null").join(r.filter("_lat is not null and _lon is not null"))
    measured = pairs.withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
    best = measured.groupBy(left_id).agg(F.min_by(F.struct("_r", "km"), F.struct("km", "_r")).alias("b"))
    return best.select(left_id, F.col("b._r").alias(right_id), F.col("b.km").alias("km"))


def pairs_within(points: DataFrame, key: str, metres: float) -> DataFrame:
    """(a, b, metres) of different points at most so far apart: each point meets those of its own and
    the eight cells around it, an equi-join, instead of all others."""
    size = metres / 111_000.0
    # a degree of longitude shrinks with latitude: cells are wide enough at the table's highest one
    wide = F.lit(size) / F.greatest(F.cos(F.radians(F.abs(F.floor("lat")) + 1)), F.lit(0.01))
    cell = points.filter("lat is not null and lon is not null").select(F.col(key).alias("k"), "lat", "lon", F.floor(F.col("lat") / size).alias("cy"), F.floor("lat").alias("band"), wide.alias("w"))
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    # longitude cells are numbered by the width of the point's own latitude band, and each point is
    # offered to its own and both neighbouring bands
    own = cell.withColumn("cx", F.floor(F.col("lon") / F.col("w")))
    other = points.filter("lat is not null and lon is not null").select(F.col(key).alias("k2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    other = other.withColumn("band", F.explode(F.sequence(F.floor("lat2") - 1, F.floor("lat2") + 1)))
    other = other.withColumn("w2", F.lit(size) / F.greatest(F.cos(F.radians(F.abs(F.col("band")) + 1)), F.lit(0.01)))
    other = other.withColumn("dy", around).withColumn("dx", around).withColumn("cy", F.floor(F.col("lat2") / size) + F.col("dy")).withColumn("cx", F.floor(F.col("lon2") / F.col("w2")) + F.col("dx"))
    far = haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), EARTH_KM * 1000)
    joined = own.join(other, ["band", "cy", "cx"]).filter("k <> k2").withColumn("metres", far).filter(F.col("metres") <= metres)
    return joined.select(F.col("k").alias("a"), F.col("k2").alias("b"), "metres").distinct()


def first_in(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order that decides every tie."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
