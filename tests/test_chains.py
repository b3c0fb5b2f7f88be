"""Journeys of several transfers: as plain loops find them, and without shuffling more than their rides."""

import random

import pytest
from pyspark.sql import functions as F

from slackline.operators import journeys

EVENTS = "event_id long, operating_day date, trip_id string, bpuic int, secs long, delay double"


def _events(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EVENTS.replace("date", "string")).withColumn("operating_day", F.to_date("operating_day"))


def _by_loops(rows, number, low, high):
    """(day, then trip, from, to, dep, arr, delay of each ride, then the waits)"""
    trips = {}
    for i, (day, trip, stop, secs, delay) in sorted(enumerate(rows), key=lambda r: (r[1][3], r[0])):
        if trip is not None:
            trips.setdefault((day, trip), []).append((stop, secs, delay))
    rides = [(day, trip, x[0], y[0], x[1], y[1], y[2]) for (day, trip), v in trips.items() for k, x in enumerate(v) for y in v[k + 1 :]]
    found = [(r,) for r in rides]
    for _ in range(number):
        found = [
            (*j, r) for j in found for r in rides
            if j[-1][0] == r[0] and j[-1][3] == r[2] and r[2] is not None and low <= r[4] - j[-1][5] <= high and all(r[1] != before[1] for before in j)
        ]
    found = [j for j in found if None not in (j[0][2], j[-1][3]) and j[0][2] != j[-1][3]]
    return sorted((j[0][0], *[v for r in j for v in r[1:]], *[b[4] - a[5] for a, b in zip(j, j[1:], strict=False)]) for j in found)


@pytest.mark.parametrize("details", [True, False])
@pytest.mark.parametrize("number, high, rows_", [(2, 2700, 240), (2, 40, 240), (3, 2700, 200), (3, 9000, 120), (4, 4000, 130)])
def test_chains_match_loops(spark, number, high, rows_, details):
    rng = random.Random(number * high)
    low = min(10, high)
    stops = [*range(-2, 5), None]
    rows = [(f"2024-01-0{rng.randrange(1, 3)}", rng.choice([None, *(f"t{k}" for k in range(14))]), rng.choice(stops), rng.randrange(0, 9_000 if high > 100 else 900), float(k)) for k in range(rows_)]
    names = [f"leg{k}_{c}" for k in range(1, number + 2) for c in ("trip", "from", "to", "dep", "arr", "delay")] + [f"xfer{k}_secs" for k in range(1, number + 1)]
    want = _by_loops(rows, number, low, high)
    if not details:
        kept = [n for n in names if n.endswith(("_trip", "_secs")) or n in ("leg1_from", f"leg{number + 1}_to")]
        want, names = sorted((w[0], *[w[1 + names.index(n)] for n in kept]) for w in want), kept
    got = journeys.transfers(journeys.sequenced(_events(spark, rows)), number, low, high, details)
    assert sorted((str(r[0]), *r[1:]) for r in got.select("operating_day", *names).collect()) == want and want
    assert {r[0] for r in got.select("n_transfers").distinct().collect()} == {number}


def test_extract_keeps_whole_legs(spark):
    rows = [("2024-01-01", "a", 1, 0, 0.0), ("2024-01-01", "a", 2, 100, 5.0), ("2024-01-01", "b", 2, 400, 1.0), ("2024-01-01", "b", 3, 500, 6.0), ("2024-01-01", "c", 3, 900, 2.0), ("2024-01-01", "c", 4, 1000, 7.0)]
    found = journeys.extract(_events(spark, rows)).filter("n_transfers = 2").select("leg1_dep", "leg1_delay", "leg2_from", "leg2_to", "leg2_delay", "leg3_from", "leg3_arr", "leg3_delay").collect()
    assert [tuple(r) for r in found] == [(0, 5.0, 2, 3, 6.0, 3, 1000, 7.0)]


def _shuffled(spark, df):
    """Rows of df, and rows written to shuffles for them."""
    sc = spark.sparkContext
    group = f"chains-{random.random()}"
    sc.setJobGroup(group, group)
    try:
        n = df.agg(F.count(F.concat_ws("", *df.columns))).collect()[0][0]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    store, written = sc._jsc.sc().statusStore(), 0
    for s in stages:
        written += store.lastStageAttempt(s).shuffleWriteRecords()
    return n, written


@pytest.mark.parametrize("number, n", [(2, 40), (3, 12)])
def test_shuffles_grow_with_rides(spark, number, n):
    """Through one chain of busy stops: n rides onto it, n along each of its parts, n off it. Twice the rides may be twice the rows shuffled, though
    they are 2 ** number times the journeys that end before the last ride."""

    def chain(n):
        rows = []
        for part in range(number + 1):
            for k in range(n):
                at = 5_000 * part + 10 * k
                rows += [("2024-01-01", f"{part}-{k}", 1000 + k if part == 0 else part, at, 0.0), ("2024-01-01", f"{part}-{k}", 2000 + k if part == number else part + 1, at + 5, 0.0)]
        return journeys.transfers(journeys.sequenced(_events(spark, rows)), number, high=9_000, details=False)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (few, wrote), (many, wrote_twice) = _shuffled(spark, chain(n)), _shuffled(spark, chain(2 * n))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert few == n ** (number + 1) and many == (2 * n) ** (number + 1)
    assert 0 < wrote_twice <= 2.2 * wrote


@pytest.mark.parametrize("name", ["j16_two_transfers", "j17_three_transfers"])
def test_rides_meet_by_place_only(spark, small, name):
    """No join compares stops or times of rides that its keys bring together: those that may follow each other are read as ranges."""
    from slackline.queries import QUERIES

    joins = [line for line in QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and not [j for j in joins if "<=" in j or ">=" in j]
