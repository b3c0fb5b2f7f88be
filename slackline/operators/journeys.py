"""Journeys mined from observed trips: legs, transfers by interval joins, strata, replays."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_TRANSFER, MAX_TRANSFER = 120, 2700
#: Tasks that share a day, in journeys of two or three transfers: so often its rides are sent.
SPLITS = 8


def sequenced(events: DataFrame) -> DataFrame:
    """Events (operating_day, trip_id, bpuic, secs, ...) with their place in the trip and the trip's length."""
    trip = Window.partitionBy("operating_day", "trip_id")
    return events.withColumn("seq", F.row_number().over(trip.orderBy("secs", "event_id"))).withColumn("length", F.max("seq").over(trip))


def legs(events: DataFrame, prefix: str, marks: Sequence[str] = ()) -> DataFrame:
    """Rides from an earlier stop of a trip to a later one, columns named by the prefix: day, trip, from, to, dep, arr, and marks of the first event."""
    b = events.select("operating_day", "trip_id", F.col("bpuic").alias(f"{prefix}_from"), F.col("secs").alias(f"{prefix}_dep"), F.col("seq").alias("_s"), *[F.col(m).alias(f"{prefix}_{m}") for m in marks])
    a = events.select("operating_day", "trip_id", F.col("bpuic").alias(f"{prefix}_to"), F.col("secs").alias(f"{prefix}_arr"), F.col("seq").alias("_t"), F.col("delay").alias(f"{prefix}_delay"))
    pairs = b.join(a, ["operating_day", "trip_id"]).filter(F.col("_s") < F.col("_t"))
    return pairs.select("operating_day", F.col("trip_id").alias(f"{prefix}_trip"), f"{prefix}_from", f"{prefix}_to", f"{prefix}_dep", f"{prefix}_arr", f"{prefix}_delay", *[f"{prefix}_{m}" for m in marks])


def within(seconds: Column, low: int, high: int) -> Column:
    return seconds.between(low, high)


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], end: str, start: str, low: int, high: int) -> DataFrame:
    """Pairs of equal keys whose right start is low to high seconds after the left end.

    Time is cut into buckets as wide as the interval, and a bucket is part of the equi-join key: a
    right row is offered to its own bucket and the one before. So a busy stop's day is spread over many
    keys, and only rows near each other in time meet. low and high aren't negative.
    """
    width = max(high, 1)
    l_ = left.withColumn("_bucket", F.floor(F.col(end) / width))
    offered = F.explode(F.sequence(F.floor(F.col(start) / width) - 1, F.floor(F.col(start) / width)))
    r_ = right.withColumn("_bucket", offered)
    return l_.join(r_, [*keys, "_bucket"]).filter(within(F.col(start) - F.col(end), low, high)).drop("_bucket")


def _rides(events: DataFrame, low: int, high: int) -> DataFrame:
    """Rides with their place among the day's in two orders: as they arrive at their last stop (_in) and as they leave their first (_out), stop by stop.
    What a ride may follow or be followed by is then a range of places: from _first to below _end of the one order, from _next to below _last of the
    other. Trips are numbered. Only events are shuffled for it; times are whole seconds.
    """
    trip, day, at = Window.partitionBy("operating_day", "trip_id"), Window.partitionBy("operating_day"), Window.partitionBy("operating_day", "bpuic")
    e = events.dropna(subset=["operating_day", "trip_id", "bpuic"]).withColumn("_k", F.row_number().over(trip.orderBy("seq")) - 1)
    e = e.withColumn("_rest", F.count("*").over(trip) - F.col("_k") - 1)
    # As many parts as asked for, which aren't put together again: a task holds few days' rides.
    e = e.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "operating_day")
    order, by_time = day.orderBy("bpuic", "secs", "event_id", "trip_id", "_k").rowsBetween(Window.unboundedPreceding, -1), at.orderBy("secs")
    e = e.withColumns({"_in": F.coalesce(F.sum("_k").over(order), F.lit(0)), "_out": F.coalesce(F.sum("_rest").over(order), F.lit(0))})

    def place(rides: str, base: str, until: int) -> Column:
        """Of the rides counted so at a stop, the first place after those up to so many seconds from now."""
        before = F.sum(rides).over(by_time.rangeBetween(Window.unboundedPreceding, until))
        return (F.min(base).over(at) + F.coalesce(before, F.lit(0))).cast("int")

    ranges = {"_first": place("_k", "_in", -high - 1), "_end": place("_k", "_in", -low), "_next": place("_rest", "_out", low - 1), "_last": place("_rest", "_out", high)}
    e = e.withColumns(ranges).select("operating_day", "trip_id", F.struct("_k", "_in", "_out", *ranges, "bpuic", "secs", "delay").alias("_e"))
    t = e.groupBy("operating_day", "trip_id").agg(F.sort_array(F.collect_list("_e")).alias("_e")).filter(F.size("_e") > 1)
    t = t.withColumn("_trip", F.row_number().over(day.orderBy("trip_id")) - 1)
    return t.select("*", F.posexplode("_e").alias("_i", "_b")).select("*", F.posexplode("_e").alias("_j", "_a")).filter("_i < _j").select(
        "operating_day", "trip_id", "_trip", (F.col("_i") + F.col("_j") == 1).alias("_once"), (F.col("_a._in") + F.col("_i")).cast("int").alias("_in"), (F.col("_b._out") + F.col("_j") - F.col("_i") - 1).cast("int").alias("_out"),
        "_b._first", "_b._end", "_a._next", "_a._last", F.col("_b.bpuic").alias("_from"), F.col("_a.bpuic").alias("_to"), F.col("_b.secs").alias("_dep"), F.col("_a.secs").alias("_arr"), F.col("_a.delay").alias("_delay"),
    )


def _chained(events: DataFrame, number: int, low: int, high: int) -> DataFrame:
    """Journeys of two or three transfers, for which only events and rides are shuffled, never journeys or parts of them.

    A day's rides are sent to SPLITS tasks as arrays in both orders, and each of these takes its share of the day's rides as second ones. Rides before and
    after are read from the arrays as ranges: none is looked at that doesn't wait as asked. What is written grows with the rides, the time with the journeys.
    """
    end, rides = number + 1, _rides(events, low, high)
    listed = lambda place, *names: F.sort_array(F.collect_list(F.struct(place, *names)))
    names = {"before": ("_trip", "_from", "_dep", "_arr", "_delay"), "after": ("_trip", "_from", "_to", "_dep", "_arr", "_delay", "_next", "_last")}
    days = rides.groupBy("operating_day").agg(listed("_in", *names["before"]).alias("before"), listed("_out", *names["after"]).alias("after"), F.sort_array(F.collect_list(F.when(F.col("_once"), F.struct("_trip", "trip_id")))).alias("_trips"))
    days = days.select("operating_day", F.col("_trips")["trip_id"].alias("_trips"), *[F.col(o)[n].alias(o + n) for o, ns in names.items() for n in ns])
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    days = days.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1)))).repartition(parts, "operating_day", "_part")
    get = lambda k, name: F.get(f"{'before' if k == 1 else 'after'}_{name}", F.col(f"_{k}"))

    def met(rows: DataFrame, k: int, others: Sequence[int]) -> DataFrame:
        """Rows whose ride k is on a trip that isn't the others'."""
        return functools.reduce(lambda r, o: r.filter(F.col(f"_trip{k}") != F.col(f"_trip{o}")), others, rows.withColumn(f"_trip{k}", get(k, "trip")))

    def placed(rows: DataFrame, k: int, start: Column, below: Column) -> DataFrame:
        """Rows with each place of a range as ride k. The outer form keeps Spark from building ranges only to test their size."""
        return rows.filter(start < below).select("*", F.explode_outer(F.sequence(start, below - 1)).alias(f"_{k}"))

    second = rides.filter("_first < _end AND _next < _last").select("operating_day", F.pmod("_out", F.lit(SPLITS)).alias("_part"), F.col("_trip").alias("_trip2"), F.col("_out").alias("_2"), "_first", "_end", "_next", "_last").repartition(parts, "operating_day", "_part")
    # A stage of generated code holds what one of its rows gives until the next. The lambda isn't generated code, so these are pairs of rides, not second rides.
    pairs = second.select("*", F.explode_outer(F.transform(F.sequence(F.col("_next"), F.col("_last") - 1), lambda place: place)).alias("_3")).drop("_next", "_last")
    journey = met(pairs.join(days.hint("shuffle_hash"), ["operating_day", "_part"]), 3, [2])
    if number == 3:
        journey = journey.filter(get(3, "next") < get(3, "last"))
    journey = met(placed(journey, 1, F.col("_first"), F.col("_end")), 1, range(2, 4))
    if number == 3:
        journey = met(placed(journey, 4, get(3, "next"), get(3, "last")), 4, range(1, 4))
    columns = {}
    for k in range(1, end + 1):
        columns |= {f"leg{k}_trip": F.get("_trips", F.col(f"_trip{k}")), f"leg{k}_from": get(k, "from"), f"leg{k}_to": get(k, "to") if k > 1 else get(2, "from")}
        columns |= {f"leg{k}_{name}": get(k, name) for name in ("dep", "arr", "delay")}
    columns |= {f"xfer{k}_secs": get(k + 1, "dep") - get(k, "arr") for k in range(1, end)}
    return journey.select("operating_day", *[c.alias(name) for name, c in columns.items()])


def transfers(events: DataFrame, number: int, low: int = MIN_TRANSFER, high: int = MAX_TRANSFER, details: bool = True, marks: Sequence[str] = ()) -> DataFrame:
    """Journeys of ``number`` transfers: rides joined at a common stop, on pairwise different trips. Those of two and three may
    come without details: the first ride's departure, the last one's arrival, and delays. Marks of events come along in those of one or none."""
    done = min(number, 3) if number > 1 else 0
    if done:
        journey = _chained(events, done, low, high)
        if not details and number <= 3:
            journey = journey.drop("leg1_dep", f"leg{done + 1}_arr", *[f"leg{k}_delay" for k in range(1, done + 2)])
    else:
        journey = legs(events, "leg1", marks)
    journey = journey.withColumn("_at", F.col(f"leg{done + 1}_to"))
    for k in range(done + 2, number + 2):
        ride = legs(events, f"leg{k}", marks if number < 2 else ()).withColumn("_at", F.col(f"leg{k}_from"))
        journey = interval_join(journey, ride, ["operating_day", "_at"], f"leg{k - 1}_arr", f"leg{k}_dep", low, high)
        for before in range(1, k):
            journey = journey.filter(F.col(f"leg{before}_trip") != F.col(f"leg{k}_trip"))
        journey = journey.withColumn(f"xfer{k - 1}_secs", F.col(f"leg{k}_dep") - F.col(f"leg{k - 1}_arr")).withColumn("_at", F.col(f"leg{k}_to"))
    return journey.filter(F.col("leg1_from") != F.col("_at")).drop("_at").withColumn("n_transfers", F.lit(number))


def hash_share(share: float, *keys: str) -> Column:
    """A repeatable sample: true for about such a share of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < int(share * 1_000_000)


def extract(events: DataFrame, most_transfers: int = 2) -> DataFrame:
    """Journeys of 0 to ``most_transfers`` transfers under one schema, where missing legs are null."""
    seq = sequenced(events)
    parts = [transfers(seq, k) for k in range(most_transfers + 1)]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p, allowMissingColumns=True)
    return result


def with_deadlines(journeys: DataFrame, buffers: Sequence[int] = (0, 600, 1800)) -> DataFrame:
    return journeys.withColumn("deadline_buffer_sec", F.explode(F.array(*[F.lit(b) for b in buffers])))


def stratified(rows: DataFrame, strata: Sequence[str], n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows of each stratum, first by a hash of their keys; the ranking's limit works before the shuffle."""
    w = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), *keys), *keys)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def equal_strata(rows: DataFrame, strata: Sequence[str], keys: Sequence[str], seed: int = 42) -> DataFrame:
    """As many rows of each stratum as the smallest has."""
    least = rows.groupBy(*strata).agg(F.count("*").alias("_k")).agg(F.min("_k").alias("_least"))
    w = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), *keys), *keys)
    return rows.withColumn("_n", F.row_number().over(w)).join(least).filter(F.col("_n") <= F.col("_least")).drop("_n", "_least")


def ground_truth(wide: DataFrame, legs_: int = 3) -> DataFrame:
    """Wide leg columns as one array of the legs that there are."""
    names = [c.removeprefix("leg1_") for c in wide.columns if c.startswith("leg1_")]
    array = F.array(*[F.struct(*[F.col(f"leg{k}_{n}").alias(n) for n in names]) for k in range(1, legs_ + 1) if f"leg{k}_trip" in wide.columns])
    return wide.withColumn("legs", F.filter(array, lambda x: x["trip"].isNotNull()))


def completes(rides: Column, known: Column, least: int = MIN_TRANSFER) -> Column:
    """Whether a route works under real delays. rides: array of (trip_id, departure_secs, arrival_secs, walk_sec: to the next ride);
    known: map of trip to real delay, whose mean stands for unknown trips. Every transfer needs ``least`` seconds."""
    values = F.map_values(known)
    mean = F.coalesce(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0)), F.lit(0.0))
    n = F.size(rides)

    def step(state, k):
        ride, after = F.get(rides, k), F.get(rides, k + 1)
        real = F.coalesce(F.try_element_at(known, ride["trip_id"]), mean)
        arrival = ride["arrival_secs"] + real + state["carry"]
        fits = (after["departure_secs"] - arrival - ride["walk_sec"]) >= least
        late = F.greatest(arrival - ride["arrival_secs"], F.lit(0.0))
        return F.struct((state["ok"] & F.coalesce(fits, F.lit(True))).alias("ok"), F.when(state["ok"], late).otherwise(state["carry"]).alias("carry"))

    start = F.struct(F.lit(True).alias("ok"), F.lit(0.0).alias("carry"))
    steps = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda s: s["ok"])


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 when both are empty, 0 when one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
