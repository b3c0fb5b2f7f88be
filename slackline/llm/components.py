"""Connected components by alternating large-star and small-star.

Each round is two joins against a partial minimum. The minima are written before they are
joined: a node that a third of all edges have is one row a task in the aggregation, and
between two plain tables Spark splits the join's hot key over many tasks. Edges are written
to the shared folder after each step; nothing is collected but their number and a hash sum,
which are taken while they are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.llm import storage

MOST_ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over edges (a, b). Large: every larger neighbour of a node is joined to the smallest
    node around it. Small: every smaller or equal neighbour, and the node itself."""
    if small:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # a table of its own: above an aggregation in the same plan a hot key's join can't be split
    least = storage.written(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
    joined = pairs.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that isn't itself its component's smallest; a written table."""
    place = storage.mark()
    state = {"n": F.count("*"), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}  # doesn't depend on the order of edges
    now, after = storage.measured(edges.select("a", "b").filter("a <> b").distinct(), "cc-edges", **state)
    for _ in range(MOST_ROUNDS if after["n"] else 0):
        now = storage.written(_star(now, small=False), "cc-large")
        before = after
        now, after = storage.measured(_star(now, small=True), "cc-small", **state)
        storage.tidy(now, place)
        if after == before:
            break
    else:
        if after["n"]:
            raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) between two nodes touches; a component is its smallest node."""
    found = stars(edges)
    roots = found.select(F.col("component").alias("node")).distinct()
    return found.unionByName(roots.withColumn("component", F.col("node")))
