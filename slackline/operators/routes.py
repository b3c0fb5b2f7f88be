"""Routes as rows with an array of steps: confidence, annotation, merging, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slackline.functions import quantiles as Q
from slackline.functions.clock import clock_text

STEPS = "array<struct<type:string,trip_id:string,line_text:string,from_stop:int,to_stop:int,departure_secs:int,arrival_secs:int,duration_sec:int,quantiles:array<double>>>"


def ride_headways(steps: Column, deadline: Column) -> Column:
    """(step_index, headway_sec, probability) of each ride: time to the next ride or the deadline, less the walks between.

    One pass from the last step to the first carries the limit (the next ride's departure or the
    deadline) and the walks since; rides are put in front of what was found.
    """
    found = "array<struct<step_index:int,headway_sec:double,probability:double>>"
    start = F.struct(deadline.cast("double").alias("limit"), F.lit(0.0).alias("walked"), F.array().cast(found).alias("rides"))

    def back(state, s):
        step = s["step"]
        headway = state["limit"] - state["walked"] - step["arrival_secs"]
        ride = F.struct(s["i"].alias("step_index"), headway.alias("headway_sec"), Q.chance_from(Q.points(step["quantiles"]), headway).alias("probability"))
        after = F.struct(step["departure_secs"].cast("double").alias("limit"), F.lit(0.0).alias("walked"), F.concat(F.array(ride), state["rides"]).alias("rides"))
        on_foot = F.struct(state["limit"].alias("limit"), (state["walked"] + F.coalesce(step["duration_sec"], F.lit(0))).alias("walked"), state["rides"].alias("rides"))
        return F.when(step["type"] == "ride", after).otherwise(on_foot)

    numbered = F.reverse(F.transform(steps, lambda x, i: F.struct(i.alias("i"), x.alias("step"))))
    return F.aggregate(numbered, start, back, lambda state: state["rides"])


def confidence(steps: Column, deadline: Column) -> Column:
    """The chance that every transfer and the deadline are met: the product over rides."""
    return F.aggregate(ride_headways(steps, deadline), F.lit(1.0), lambda a, x: a * x["probability"])


def annotate(routes: DataFrame, q: float) -> DataFrame:
    """Routes (steps, deadline_secs) with their confidence, the first missed connection, the robust arrival, and whether they pass."""
    level = F.lit(q if q <= 1 else q / 100)
    judged = routes.withColumn("_rides", ride_headways(F.col("steps"), F.col("deadline_secs")))

    def delay(s):
        return F.when((s["type"] == "ride") & s["quantiles"].isNotNull(), Q.at_level(Q.clean(s["quantiles"]), level)).otherwise(F.lit(0.0))

    def move(cursor, s):
        start = F.greatest(F.coalesce(s["departure_secs"].cast("double"), cursor, F.lit(0.0)), F.coalesce(cursor, s["departure_secs"].cast("double"), F.lit(0.0)))
        return F.when(s["type"] == "ride", s["arrival_secs"] + delay(s)).otherwise(start + F.coalesce(s["duration_sec"], F.lit(0)))

    arrival = F.aggregate("steps", F.lit(None).cast("double"), move)
    missed = F.get(F.filter("_rides", lambda r: r["headway_sec"] < 0), F.lit(0))
    out = judged.withColumns({
        "route_confidence": F.aggregate("_rides", F.lit(1.0), lambda a, x: a * x["probability"]), "missed_step": missed["step_index"], "missed_headway": missed["headway_sec"],
        "robust_arrival_secs": arrival, "robust_arrival_time": clock_text(arrival),
    })
    return out.withColumn("passes_confidence", F.col("missed_step").isNull() & (F.col("route_confidence") >= level)).drop("_rides")


def attach_quantiles(steps: DataFrame, lookups: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Steps with the quantiles of the first lookup (quantiles by keys) that knows their key."""
    result = steps
    for k, (lookup, keys) in enumerate(lookups):
        result = result.join(lookup.select(*keys, F.col("quantiles").alias(f"_q{k}")), keys, "left")
    return result.withColumn("quantiles", F.coalesce(*[F.col(f"_q{k}") for k in range(len(lookups))])).drop(*[f"_q{k}" for k in range(len(lookups))])


def coarser(lookup: DataFrame, keys: list[str]) -> DataFrame:
    """A lookup on fewer keys: quantiles averaged level by level and put in order."""
    n = len(Q.LEVELS)
    means = lookup.withColumn("_c", Q.clean(F.col("quantiles"))).groupBy(*keys).agg(*[F.avg(F.get("_c", F.lit(i))).alias(f"_m{i}") for i in range(n)])
    return means.select(*keys, F.array_sort(F.array(*[F.col(f"_m{i}") for i in range(n)])).alias("quantiles"))


def step_table(routes: DataFrame, key: str) -> DataFrame:
    return routes.select(key, F.posexplode("steps").alias("step_index", "s")).select(key, "step_index", "s.*")


def merge_rides(steps: DataFrame, key: str) -> DataFrame:
    """Neighbouring rides on one trip become one: a new group starts where the type or the trip changes."""
    w = Window.partitionBy(key).orderBy("step_index")
    fresh = F.when((F.col("type") == "ride") & (F.lag("type").over(w) == "ride") & (F.col("trip_id") == F.lag("trip_id").over(w)), 0).otherwise(1)
    grouped = steps.withColumn("_new", fresh).withColumn("_group", F.sum("_new").over(w))
    ends = lambda c, f: f(F.col(c), F.col("step_index"))
    out = grouped.groupBy(key, "_group").agg(F.first("type").alias("type"), F.first("trip_id").alias("trip_id"), ends("from_stop", F.min_by).alias("from_stop"), ends("to_stop", F.max_by).alias("to_stop"), ends("departure_secs", F.min_by).alias("departure_secs"), ends("arrival_secs", F.max_by).alias("arrival_secs"))
    return out.withColumnRenamed("_group", "step_index")


def signature(steps: Column, stops: bool = True) -> Column:
    """Equal for routes that take the same steps at the same times; without stops, for those that ride the same trips at the same times."""

    def part(s):
        ends = [s["from_stop"].cast("string"), s["to_stop"].cast("string")] if stops else []
        return F.concat_ws("|", s["type"], F.coalesce(s["trip_id"], F.lit("")), *ends, s["departure_secs"].cast("string"), s["arrival_secs"].cast("string"))

    return F.sha1(F.concat_ws(";", F.transform(steps, part)).cast("binary"))


def best_first(routes: DataFrame) -> DataFrame:
    """Latest departure, then fewest transfers, then least walking."""
    return routes.orderBy(F.desc("departure_secs"), "n_transfers", "total_walk_m")


def pareto(pairs: DataFrame, key: str) -> DataFrame:
    """(departure, arrival) pairs that no later or equal departure beats."""
    distinct = pairs.groupBy(key, "departure_secs").agg(F.min("arrival_secs").alias("arrival_secs"))
    w = Window.partitionBy(key).orderBy(F.desc("departure_secs")).rowsBetween(Window.unboundedPreceding, -1)
    return distinct.withColumn("_best", F.min("arrival_secs").over(w)).filter("_best is null or arrival_secs < _best").drop("_best")


def inserted(pairs: DataFrame, key: str) -> DataFrame:
    """pareto() by insertion: a pair is turned away if one that is kept leaves no earlier and arrives no later, and else drives out
    those it beats. What is folded is one pair a departure, so a key's array is no longer than its departures."""
    distinct = pairs.groupBy(key, "departure_secs").agg(F.min("arrival_secs").alias("arrival_secs"))
    pair = F.struct("departure_secs", "arrival_secs")
    beats = lambda a, b: (a["departure_secs"] >= b["departure_secs"]) & (a["arrival_secs"] <= b["arrival_secs"])
    kind = f"array<struct<departure_secs:{distinct.schema['departure_secs'].dataType.simpleString()},arrival_secs:{distinct.schema['arrival_secs'].dataType.simpleString()}>>"

    def insert(kept, x):
        return F.when(F.exists(kept, lambda y: beats(y, x)), kept).otherwise(F.concat(F.filter(kept, lambda y: ~beats(x, y)), F.array(x)))

    folded = distinct.groupBy(key).agg(F.collect_list(pair).alias("_all")).withColumn("_kept", F.aggregate("_all", F.array().cast(kind), insert))
    return folded.select(key, F.inline("_kept"))


def from_rides(rides: DataFrame, key: str, walk_seconds: Column) -> DataFrame:
    """The way back from step_table(): routes with their array of steps, from rides in order of step_index, with a walk of ``walk_seconds`` where a
    ride doesn't start where the last one ended. A route's steps are few, so its array is built in one group."""
    w = Window.partitionBy(key).orderBy("step_index")
    step = lambda type_, trip, a, b, dep, arr: F.struct(F.lit(type_).alias("type"), trip.alias("trip_id"), a.alias("from_stop"), b.alias("to_stop"), dep.alias("departure_secs"), arr.alias("arrival_secs"))
    ride = step("ride", F.col("trip_id"), F.col("from_stop"), F.col("to_stop"), F.col("departure_secs"), F.col("arrival_secs"))
    walk = step("walk", F.lit(None).cast("string"), F.col("to_stop"), F.col("_next"), F.col("arrival_secs"), F.col("arrival_secs") + walk_seconds)
    own = F.when(F.col("_next") != F.col("to_stop"), F.array(ride, walk)).otherwise(F.array(ride))
    parts = rides.withColumn("_next", F.lead("from_stop").over(w)).select(key, "step_index", own.alias("own"))
    listed = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step_index", "own"))).alias("_p"))
    return listed.select(key, F.flatten(F.transform("_p", lambda x: x["own"])).alias("steps"))
