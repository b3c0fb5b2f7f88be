"""Domain operators on small fixtures, against plain versions and published expectations."""

import math
import random
from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from slackline.functions import cleaning, clock, geo
from slackline.functions import quantiles as Q
from slackline.operators import evaluation, features, journeys, lifecycle, models, routes, timetable, walks
from slackline.plans import scan
from slackline.queries import QUERIES, domain
from slackline.sources import tables

SLOW = [120.0, 180.0, 240.0, 360.0, 420.0, 480.0, 600.0]
FAST = [30.0, 50.0, 70.0, 90.0, 135.0, 180.0, 300.0]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def array(values):
    return F.array(*[F.lit(v) for v in values]) if values is not None else F.lit(None).cast("array<double>")


def ride(dep, arr, quantiles=None, trip="t", a=1, b=2):
    return ("ride", trip, "L", a, b, dep, arr, arr - dep, quantiles)


def walk(seconds, a=2, b=2):
    return ("walk", None, None, a, b, 0, 0, seconds, None)


def annotated(spark, steps, deadline, q):
    df = spark.createDataFrame([(steps, deadline)], f"steps {routes.STEPS}, deadline_secs int")
    return routes.annotate(df, q).first()


H = 3600


def test_route_fails_on_slow_quantiles(spark):
    r = annotated(spark, [ride(8 * H, 8 * H + 1800, SLOW), ride(8 * H + 2100, 9 * H, SLOW, "u")], 9 * H + 600, 0.9)
    assert r["route_confidence"] == pytest.approx(0.7125) and not r["passes_confidence"] and r["missed_step"] is None


def test_route_passes_on_fast_quantiles(spark):
    r = annotated(spark, [ride(8 * H, 8 * H + 1200, FAST), ride(8 * H + 1800, 8 * H + 3000, FAST, "u")], 9 * H, 0.95)
    assert r["passes_confidence"] and r["robust_arrival_time"] == "08:55:00"


def test_missed_connection(spark):
    r = annotated(spark, [ride(8 * H, 8 * H + 2100, FAST), ride(8 * H + 1800, 9 * H, FAST, "u")], 10 * H, 0.5)
    assert r["missed_step"] == 0 and r["missed_headway"] < 0 and not r["passes_confidence"]


def test_single_leg_headway_and_unknown_quantiles(spark):
    df = spark.createDataFrame([([ride(8 * H, 9 * H, None)], 9 * H + 600)], f"steps {routes.STEPS}, deadline_secs int")
    assert df.select(routes.ride_headways(F.col("steps"), F.col("deadline_secs"))).first()[0][0]["headway_sec"] == 600.0
    r = annotated(spark, [ride(8 * H, 9 * H, None)], 9 * H + 600, 0.4)
    assert r["route_confidence"] == 0.5 and r["passes_confidence"]


def test_walks_between_rides_cost_headway(spark):
    df = spark.createDataFrame([([ride(0, 100, FAST), walk(60), walk(30), ride(400, 500, FAST, "u"), walk(50)], 600)], f"steps {routes.STEPS}, deadline_secs int")
    got = [(x["step_index"], x["headway_sec"]) for x in df.select(routes.ride_headways(F.col("steps"), F.col("deadline_secs"))).first()[0]]
    assert got == [(0, 210.0), (3, 50.0)]


def plain_extrapolated(h, quantiles):
    if h < 0:
        return 0.0
    known = [(max(0.0, q), p) for q, p in zip(quantiles or [], Q.LEVELS) if q is not None and q == q]
    if not known:
        return 0.5
    points = {}
    for x, p in zip(sorted(x for x, _ in known), sorted(p for _, p in known)):
        points[x] = max(p, points.get(x, 0))
    pts = sorted(points.items())
    if h <= pts[0][0]:
        return pts[0][1] if pts[0][0] == 0 else h / pts[0][0] * pts[0][1]
    if h >= pts[-1][0]:
        return min(1.0, pts[-1][1] + (pts[-1][1] - pts[-2][1]) / (pts[-1][0] - pts[-2][0]) * (h - pts[-1][0])) if len(pts) > 1 else 1.0
    k = max(i for i, (x, _) in enumerate(pts) if x <= h)
    (x0, p0), (x1, p1) = pts[k], pts[k + 1]
    return p0 + (h - x0) / (x1 - x0) * (p1 - p0)


def test_distributions_as_columns(spark):
    rng = random.Random(1)
    rows = [(float(rng.choice([-5, 0, 10, 55, 130, 800])), None if rng.random() < 0.1 else [rng.choice([-3.0, 0.0, 20.0, 20.0, 60.0, 200.0, float("nan"), None]) if rng.random() < 0.3 else float(rng.randint(0, 300)) for _ in range(7)]) for _ in range(300)]
    df = spark.createDataFrame(rows, "h double, q array<double>")
    got = df.select("h", "q", Q.chance_extrapolated(F.col("q"), F.col("h")).alias("p"), Q.chance_within(F.array_sort(Q.clean(F.col("q"))), F.col("h")).alias("w")).collect()
    for r in got:
        assert r["p"] == pytest.approx(plain_extrapolated(r["h"], r["q"])), r
        if r["q"] is not None and r["h"] >= 0:
            clean = sorted([max(0.0, x) if x is not None and x == x else 0.0 for x in r["q"]])
            assert r["w"] == pytest.approx(scan.chance_within(clean, r["h"])), r


@pytest.mark.parametrize(("q", "level"), [(0.88, 0.90), (0.50, 0.50), (0.95, 0.95), (0.99, 0.95), (0.0, 0.50)])
def test_level_choice(spark, q, level):
    assert one(spark, x=Q.at_level(array(list(Q.LEVELS)), F.lit(q)))["x"] == level


def test_confidence_input(spark):
    r = one(spark, a=Q.confidence(F.lit(90)), b=Q.confidence(F.lit(0.9)), c=Q.confidence(F.lit(None).cast("double")), d=Q.confidence(F.lit(-1.0)), e=Q.confidence(F.lit(500)))
    assert tuple(r) == (0.9, 0.9, 0.75, 0.0, 1.0)


def test_clean_quantiles(spark):
    r = one(spark, a=Q.clean(array([5.0, -1.0, float("nan")])), b=Q.clean(array([float(x) for x in range(9, 0, -1)])))
    assert r["a"] == [0.0] * 6 + [5.0] and r["b"] == [3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]


def test_clocks(spark):
    s = lambda t: clock.clock_seconds(F.lit(t))
    r = one(spark, a=s("46:24:00"), b=s("08:30"), c=s("x"), d=s("12:61:00"), e=clock.clock_text(F.lit(167040)), f=clock.clock_text(F.lit(90000), wrap=True), g=clock.weekday_name(F.lit("2026-01-01")), h=clock.weekday_name(F.lit(" Monday ")), i=clock.deadline_seconds(F.lit("2026-01-02T01:00:00"), F.lit("2026-01-01").cast("date")))
    assert tuple(r) == (167040, 30600, None, None, "46:24:00", "01:00:00", "thursday", "monday", 90000)


def test_easter_and_flags(spark):
    days = {2024: date(2024, 3, 31), 2025: date(2025, 4, 20), 2026: date(2026, 4, 5), 1996: date(1996, 4, 7), 2000: date(2000, 4, 23), 2038: date(2038, 4, 25)}
    got = spark.createDataFrame([(y,) for y in days], "y int").select("y", features.easter(F.col("y")).alias("e")).collect()
    assert {r["y"]: r["e"] for r in got} == days
    flags = features.holiday_flags(features.public_holidays(spark, 2025, 2026, ["ZH", "VD"]))
    asked = spark.createDataFrame([("ZH", date(2026, 1, 1)), ("ZH", date(2026, 3, 3)), ("XX", date(2026, 1, 1)), ("VD", date(2026, 5, 15))], "canton string, day date")
    got = {(r["canton"], r["day"]): (r["holiday"], r["before"], r["after"], r["bridge"], r["day_type"]) for r in features.flags_of(asked, flags, ["ZH", "VD"]).collect()}
    assert got[("ZH", date(2026, 1, 1))][0] == 1 and got[("ZH", date(2026, 3, 3))] == (0, 0, 0, 0, 0) and got[("XX", date(2026, 1, 1))][0] == 1
    assert got[("VD", date(2026, 5, 15))] == (0, 0, 1, 1, 2)  # the Friday after Ascension


def test_cleaning(spark):
    raw = [("2024-01-01", "t1", "o", "BUS", None, "", 0, 90), ("2024-01-01", "t1", "o", "t", False, "real", 0, 7200), ("2024-01-01", "t2", "o", "B", True, "REAL", 0, 0), ("2024-01-01", "t3", "o", "B", False, "Unbekannt", 0, 0), ("2024-01-01", " ", "o", "B", False, "REAL", 0, 0), ("2024-02-01", "t4", "o", "B", False, "REAL", 0, 0), ("2024-01-02", "t5", "o", "B", False, "REAL", 100, 40)]
    df = spark.createDataFrame(raw, "operating_day string, trip_id string, operator_id string, transport string, failed boolean, arr_status string, s int, a int")
    df = df.withColumn("operating_day", F.to_date("operating_day")).withColumn("arr_time", F.timestamp_seconds("s")).withColumn("arr_actual", F.timestamp_seconds("a"))
    got = {(r["trip_id"], r["product"], r["arr_status"]): (r["delay_min"], r["label_delay_min"]) for r in features.clean_events(df, "2024-01-01", "2024-01-31").collect()}
    assert got == {("t1", "BUS", "PROGNOSE"): (1.5, 1.5), ("t1", "TRAM", "REAL"): (120.0, 60.0), ("t5", "BUS", "REAL"): (-1.0, 0.0)}


def test_connections_bridge_gaps_and_drop_anomalies(spark):
    rows = [("a", 1, 1, 0), ("a", 2, 3, 600), ("a", 2, 4, 700), ("a", 3, 5, 650), ("b", 1, 1, 0), ("b", 2, 2, 90_000), ("c", 1, 1, 100_000), ("c", 2, 2, 100_300)]
    st = spark.createDataFrame(rows, "trip_id string, stop int, stop_sequence int, arr_secs int")
    got = sorted((r["trip_id"], r["dep_stop"], r["arr_stop"], r["dep_secs"], r["arr_secs"]) for r in timetable.build_connections(st).collect())
    assert got == [("a", 1, 2, 0, 600), ("c", 1, 2, 100_000, 100_300)]
    v = timetable.validate(spark.createDataFrame([("x", 1, 1, 1, 5, 3), ("x", 1, 1, 2, None, 3)], "trip_id string, dep_seq int, dep_stop int, arr_stop int, dep_secs int, arr_secs int")).first()
    assert tuple(v) == (2, 1, 1, 1, 1)


def test_stop_numbers(spark):
    rows = [("8501120:0:1", "A", 1.0, 2.0), ("8501120:0:2", "B", 3.0, 4.0), ("Parent8501", "C", 0.0, 0.0)]
    got = timetable.build_stops(spark.createDataFrame(rows, "stop_id string, stop_name string, stop_lat double, stop_lon double")).collect()
    assert [tuple(r) for r in got] == [(8501120, "B", 2.0, 3.0)]


def test_point_in_polygon(spark):
    l_shape = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
    areas = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in l_shape])], "area int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 0.5, 3.0), (2, 3.0, 0.5), (3, 2.0, 2.0), (4, -1.0, 0.5), (5, 3.5, 3.5)], "p int, x double, y double")
    assert {r["p"] for r in geo.assign_areas(points, areas, "p", "area").collect()} == {1, 2}


def plain_metres(a, b):
    f = math.radians
    x = math.sin(f(b[0] - a[0]) / 2) ** 2 + math.cos(f(a[0])) * math.cos(f(b[0])) * math.sin(f(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(x))


def test_pairs_within(spark):
    rng = random.Random(2)
    points = {i: (45.95 + rng.random() * 0.1, 6 + rng.random() * 0.1) for i in range(200)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "k int, lat double, lon double")
    got = {(r["a"], r["b"]) for r in geo.pairs_within(df, "k", 700.0).collect()}
    assert got == {(i, j) for i in points for j in points if i != j and plain_metres(points[i], points[j]) <= 700.0}


def test_shortest_paths(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(30), rng.randrange(30)): rng.randint(1, 100) for _ in range(120)}
    edges = {k: v for k, v in edges.items() if k[0] != k[1]}
    best = {}
    for s in range(5):
        dist, todo = {s: 0}, [s]
        while todo:
            u = todo.pop()
            for (a, b), w in edges.items():
                if a == u and dist[u] + w <= 150 and dist[u] + w < dist.get(b, 1e9):
                    dist[b] = dist[u] + w
                    todo.append(b)
        best |= {(s, n): d for n, d in dist.items()}
    e = spark.createDataFrame([(a, b, float(w)) for (a, b), w in edges.items()], "a long, b long, metres double").cache()
    keep = lambda df, k: spark.createDataFrame(df.collect(), df.schema)
    got = walks.shortest_within(e, spark.range(5).withColumnRenamed("id", "source"), 150.0, keep)
    assert {(r["source"], r["node"]): r["metres"] for r in got.collect()} == best


def network(seed, stops=8, trips=25):
    rng = random.Random(seed)
    c = []
    for t in range(trips):
        at, time = rng.randrange(stops), rng.randrange(0, 6000)
        for _ in range(rng.randint(1, 5)):
            to, arr = rng.randrange(stops), time + rng.randrange(60, 900)
            if to != at:
                c.append(scan.Connection(at, to, time, arr, f"t{t}"))
            at, time = to, arr + rng.randrange(0, 120)
    pairs = {(i, j): rng.randrange(60, 400) for i in range(stops) for j in range(i) if rng.random() < 0.2}
    return scan.Timetable(c, [(*ends, s, float(s)) for (i, j), s in pairs.items() for ends in ((i, j), (j, i))])


@pytest.mark.parametrize("seed", range(40))
def test_forward_scan_against_relaxation(seed):
    table = network(seed)
    got = scan.earliest_arrivals(table, 0, 300, None, 500.0)
    # a state is a stop on foot or a seat on a trip; walks don't chain, as in the scan
    best, seats = {0: 300} | {b: 300 + s for b, s, m in table.walks.get(0, ())}, set()
    changed = True
    while changed:
        changed = False
        for c in table.connections:
            if c.dep >= 300 and ((c.trip, c.dep) in seats or best.get(c.dep_stop, 1e9) <= c.dep):
                for d in table.connections:
                    if d.trip == c.trip and d.dep >= c.dep and (d.trip, d.dep) not in seats:
                        seats.add((d.trip, d.dep))
                        changed = True
                for stop, t in [(c.arr_stop, c.arr), *((b, c.arr + s) for b, s, m in table.walks.get(c.arr_stop, ()))]:
                    if t < best.get(stop, 1e9):
                        best[stop] = t
                        changed = True
    assert got == best


@pytest.mark.parametrize("seed", range(25))
def test_backward_scan_agrees_with_forward_scans(seed):
    """Without transfer times, the latest departure is the last one from which the goal is reached in time."""
    table = network(seed)
    deadline = 6000
    for goal in range(1, 5):
        found = scan.latest_departures(table, 0, goal, deadline, 0.0, window=deadline, max_walk=500.0, max_routes=50, min_transfer=0)
        for r in found:
            assert r["departure_secs"] <= r["arrival_secs"] <= deadline
            assert scan.earliest_arrivals(table, 0, r["departure_secs"], goal, 500.0).get(goal, 1e9) <= r["arrival_secs"]
            steps = r["steps"]
            assert steps[0]["from_stop"] == 0 and steps[-1]["to_stop"] == goal
            assert all(a["to_stop"] == b["from_stop"] and a["arrival_secs"] <= b["departure_secs"] for a, b in zip(steps, steps[1:]))
        keys = [(-r["departure_secs"], r["n_transfers"], r["total_walk_m"]) for r in found]
        assert keys == sorted(keys)


def test_walking_budget():
    c = [scan.Connection(2, 3, 1000, 1600, "t")]
    w = [(1, 2, 300, 300.0), (2, 1, 300, 300.0), (3, 4, 300, 300.0), (4, 3, 300, 300.0)]
    table = scan.Timetable(c, w)
    assert scan.latest_departures(table, 1, 4, 4000, max_walk=500.0, window=4000) == []
    (route,) = scan.latest_departures(table, 1, 4, 4000, max_walk=600.0, window=4000)
    assert route["total_walk_m"] == 600.0 and [s["type"] for s in route["steps"]] == ["walk", "ride", "walk"] and route["n_transfers"] == 0


def test_confidence_gate():
    tight = scan.Connection(1, 2, 1000, 1600, "late", (10.0, 20.0, 30.0, 60.0, 90.0, 120.0, 300.0))
    early = scan.Connection(1, 2, 200, 800, "early", tight.quantiles)
    table = scan.Timetable([tight, early], [])
    departures = lambda q: [r["departure_secs"] for r in scan.latest_departures(table, 1, 2, 1650, q, window=1650)]
    assert departures(0.5) == [1000] or departures(0.5) == [1000, 200]
    assert departures(0.95) == [200]


def test_planner_as_operator(spark):
    c = spark.createDataFrame([("monday", 1, 2, 1000, 1600, "a"), ("monday", 2, 3, 1800, 2400, "b"), ("sunday", 1, 3, 1000, 1100, "c")], "day string, dep_stop int, arr_stop int, dep_secs int, arr_secs int, trip_id string")
    w = spark.createDataFrame([], "a int, b int, secs int, metres double")
    q = spark.createDataFrame([(1, "monday", 1, 3, 3000, 0.0), (2, "sunday", 1, 3, 3000, 0.0), (3, "monday", 3, 1, 3000, 0.0)], "query_id long, day string, start int, goal int, deadline_secs int, q double")
    got = {r["query_id"]: r for r in scan.plan_routes(c, w, q).collect()}
    assert set(got) == {1, 2} and got[1]["n_transfers"] == 1 and got[2]["arrival_secs"] == 1100
    asked = q.select("query_id", "day", "start", F.lit(900).alias("depart_secs"))
    reached = {(r["query_id"], r["stop"]): r["arrival_secs"] for r in scan.reach_all(c, w, asked, 5000).collect()}
    assert reached[(1, 3)] == 2400 and reached[(2, 3)] == 1100 and (3, 1) not in reached


def test_transfers_match_plain_join(spark):
    rng = random.Random(4)
    rows = [(i, f"t{rng.randrange(12)}", rng.randrange(5), rng.randrange(0, 20_000), 1.0) for i in range(120)]
    e = spark.createDataFrame(rows, "event_id long, trip_id string, bpuic int, secs long, delay double").withColumn("operating_day", F.lit("2024-01-01").cast("date"))
    got = sorted((r["leg1_trip"], r["leg2_trip"], r["leg1_from"], r["leg2_to"], r["xfer1_secs"], r["leg1_dep"], r["leg2_arr"]) for r in journeys.transfers(journeys.sequenced(e), 1).collect())
    trips = {}
    for i, t, stop, s, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        trips.setdefault(t, []).append((stop, s))
    legs = [(t, x[0], y[0], x[1], y[1]) for t, v in trips.items() for k, x in enumerate(v) for y in v[k + 1 :]]
    want = sorted((a[0], b[0], a[1], b[2], b[3] - a[4], a[3], b[4]) for a in legs for b in legs if a[2] == b[1] and a[0] != b[0] and 120 <= b[3] - a[4] <= 2700 and a[1] != b[2])
    assert got == want and want


def test_walks_between_places(spark):
    """Stops that share points, planned by walks between places and between stops: the same routes and arrivals."""
    rng = random.Random(8)
    at = spark.createDataFrame([(k, 46.0 + k % 4 * 0.01, 6.0) for k in range(12)], "stop int, lat double, lon double")
    near = walks.straight_footpaths(at, 1500.0, 1000.0, 1.0)
    places, between = walks.straight_between_places(at, 1500.0, 1000.0, 1.0)
    timed = lambda w: w.select("a", "b", (F.col("walk_time_min") * 60).cast("int").alias("secs"), F.col("distance").alias("metres"))
    rows = []
    for t in range(60):
        stop, time = rng.randrange(12), rng.randrange(0, 90) * 60
        for _ in range(rng.randint(1, 4)):
            to, arr = rng.randrange(12), time + rng.randrange(1, 15) * 60
            if to != stop:
                rows.append(("monday", stop, to, time, arr, f"t{t}", [10.0, 30.0, 60.0, 90.0, 120.0, 200.0, 400.0] if to % 2 else None))
            stop, time = to, arr
    c = spark.createDataFrame(rows, "day string, dep_stop int, arr_stop int, dep_secs int, arr_secs int, trip_id string, quantiles array<double>")
    q = spark.createDataFrame([(k, "monday", k % 12, (k * 5 + 1) % 12, 6000, k % 3 * 0.4) for k in range(24) if k % 12 != (k * 5 + 1) % 12], "query_id long, day string, start int, goal int, deadline_secs int, q double")
    both = [timed(near), scan.PlaceWalks(timed(between), places)]
    planned = [sorted(scan.plan_routes(c, w, q, max_walk=5000.0).collect(), key=lambda r: (r["query_id"], r["route_rank"])) for w in both]
    assert planned[0] == planned[1] and any(s["type"] == "walk" for r in planned[0] for s in r["steps"])
    asked = q.select("query_id", "day", "start", F.lit(900).alias("depart_secs"))
    reached = [sorted(scan.reach_all(c, w, asked, 5000, 5000.0).collect()) for w in both]
    assert reached[0] == reached[1] and reached[0]
    assert timed(between).count() < timed(near).count() / 3


def test_replay(spark):
    rides = F.array(*[F.struct(F.lit(t).alias("trip_id"), F.lit(float(d)).alias("departure_secs"), F.lit(float(a)).alias("arrival_secs"), F.lit(float(w)).alias("walk_sec")) for t, d, a, w in (("a", 0, 100, 30), ("b", 400, 500, 0))])
    known = lambda x: F.create_map(F.lit("a"), F.lit(float(x)))
    none = F.from_json(F.lit("{}"), "map<string,double>")
    r = one(spark, fits=journeys.completes(rides, known(150)), late=journeys.completes(rides, known(151)), unknown=journeys.completes(rides, none), single=journeys.completes(F.slice(rides, 1, 1), known(9999)))
    assert tuple(r) == (True, False, True, True)


def test_region_keys(spark):
    key = lambda *u: tables.region_key(F.array(*[F.lit(x) for x in u]) if u else F.array().cast("array<string>"))
    r = one(spark, a=key("b", "a"), b=key(" a", "b "), c=key(), d=key("a"))
    assert r["a"] == r["b"] != r["d"] and r["a"].startswith("region_") and len(r["a"]) == 19 and r["c"] == "global"


def test_state_and_updates(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    assert lifecycle.load_state(spark, path) == lifecycle.State()
    state = lifecycle.State("green", date(2025, 1, 1), date(2026, 1, 31), (date(2026, 1, 5),))
    lifecycle.save_state(spark, state, path)
    assert lifecycle.load_state(spark, path) == state and state.idle == "blue"
    with pytest.raises(ValueError):
        lifecycle.State("red")
    calls, seen = [], set()

    def fetch(day):
        calls.append(day)
        if day == date(2026, 2, 2):
            raise OSError
        return None

    append = lambda days: lifecycle.append_days(days, fetch, seen.__contains__, lambda d, _: seen.add(d))
    trained, trimmed = [], []
    after = lifecycle.update(state, date(2026, 2, 3), append, lambda: False, lambda *x: trained.append(x), trimmed.append)
    assert not trained and after.failed == (date(2026, 2, 2),) and after.active == "green" and calls.count(date(2026, 2, 2)) == 3
    after = lifecycle.update(state, date(2026, 2, 8), append, lambda: False, lambda *x: trained.append(x), trimmed.append)
    assert after.active == "blue" and trained[0][0] == "blue" and trimmed == [8] and after.end == date(2026, 2, 8)


def test_vocabulary_keeps_unknown_labels(spark):
    from pyspark.ml import Pipeline

    train = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "c string, x double")
    model = Pipeline(stages=models.feature_stages(["c"], ["x"])).fit(train)
    got = {r["c"]: r["c_idx"] for r in model.transform(spark.createDataFrame([("a", 0.0), ("b", 0.0), ("z", 0.0)], "c string, x double")).collect()}
    assert got == {"a": 0.0, "b": 1.0, "z": 2.0}


def test_linear_quantile_regression(spark):
    rng = random.Random(5)
    rows = [(x, 3 * x + rng.random() * 10) for x in (rng.random() * 10 for _ in range(800))]
    a, b = models.pinball_linear(spark.createDataFrame(rows, "x double, y double"), ["x"], "y", 0.9, rounds=60)
    share = sum(y <= a * x + b for x, y in rows) / len(rows)
    assert 2 < a < 4 and 0.85 < share < 0.95


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 2.0)], "y double, p double")
    m = evaluation.regression_metrics(df, "y", "p").first()
    assert m["rmse"] == pytest.approx(math.sqrt(10 / 3)) and m["mae"] == pytest.approx(4 / 3) and m["r2"] == pytest.approx(1 - 10 / 8) and m["under_rate"] == pytest.approx(1 / 3)
    lookup = spark.createDataFrame([("a__b__c__d__e__f", SLOW), ("a__b", [1.0]), ("a__b__c__d__e__g", [9000.0, 1.0])], "key string, quantiles array<double>")
    assert tuple(evaluation.check_artifact(lookup).first()) == (3, 1, 2, 1, 1)


def test_plans_push_filters_and_prune_columns(spark, small):
    from slackline.queries import QUERIES

    plan = lambda n: QUERIES[n](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual" in plan("p1_date_range")
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan("s1_scan")
    assert "WindowGroupLimit" in plan("w7_hourly_top5")


def test_severity_and_strata(spark):
    r = one(spark, a=cleaning.severity(F.lit(-4.0)), b=cleaning.severity(F.lit(3.0)), c=cleaning.severity(F.lit(500.0)), d=cleaning.time_of_day(F.lit(2)), e=cleaning.time_of_day(F.lit(27)), f=cleaning.tightness(F.lit(299), F.lit(1)), g=cleaning.tightness(F.lit(299), F.lit(0)))
    assert tuple(r) == ("NO DELAY", "NORMAL DELAY", "EXCESSIVE_DELAY", "night", "night", "tight", "none")


def test_settings(monkeypatch):
    from slackline.settings import get_settings

    monkeypatch.setenv("SLACKLINE_MAX_WALK", "750")
    monkeypatch.setenv("SLACKLINE_REGIONS", "a, b")
    s = get_settings(sample_seed=7)
    assert (s.max_walk, s.regions, s.sample_seed, s.walking_speed) == (750.0, ("a", "b"), 7, 50.0)
    with pytest.raises(TypeError):
        get_settings(nonsense=1)
    with pytest.raises(AttributeError):
        s.max_walk = 1.0


def test_match_trips_by_hand(spark):
    """An observed trip without a first arrival and a last departure; plans that differ in a clock, a day or a stop."""
    runs, secs = "array(true, true, true, true, true, false, false)", {c: clock.clock_seconds(F.col(c)) for c in ("arr", "dep")}
    plan = [("good", 1, 1, "07:59:00", "08:00:00"), ("good", 2, 2, "08:10:00", "08:11:00"), ("good", 3, 3, "08:20:00", "08:21:00"), ("late", 1, 1, "07:59:00", "08:00:00"), ("late", 2, 2, "08:12:00", "08:13:00"), ("night", 7, 1, "25:00:00", "25:01:00")]
    planned = spark.createDataFrame(plan, "trip_id string, stop int, stop_sequence int, arr string, dep string").selectExpr("*", "'x' AS agency", f"{runs} AS runs").withColumns(secs)
    seen = [("o", 1, None, "08:00:00", 0), ("o", 2, "08:10:00", "08:11:00", 0), ("o", 3, "08:20:00", None, 0), ("sunday", 1, None, "08:00:00", 6), ("n", 7, "01:00:00", "01:01:00", 4), ("blank", 3, None, None, 1)]
    observed = spark.createDataFrame(seen, "obs_trip string, stop int, arr string, dep string, weekday int").selectExpr("*", "'x' AS agency").withColumns(secs)
    got = sorted(map(tuple, features.match_trips(planned, observed).collect()))
    assert got == [("blank", "good"), ("n", "night"), ("o", "good")]
    other = observed.withColumn("agency", F.lit("y"))
    assert features.match_trips(planned, other).isEmpty() and features.match_trips(planned.limit(0), observed).isEmpty()


def test_steps_of_routes_hang_together(spark, small):
    """Each route starts and ends where it was asked to, step after step, and its rides run in the timetable."""
    asked = {r["query_id"]: r for r in domain._queries(spark, small, 30).collect()}
    rides = {(r["trip_id"], r["dep_stop"], r["dep_secs"]) for r in domain._network(spark, small)[0].select("trip_id", "dep_stop", "dep_secs").collect()}
    found = defaultdict(list)
    for r in QUERIES["d20_reconstruct_route"](spark, small).collect():
        found[r["query_id"], r["route_rank"]].append(r)
    assert found
    for (query, _), steps in found.items():
        steps.sort(key=lambda s: s["step_index"])
        assert [s["step_index"] for s in steps] == list(range(len(steps)))
        assert steps[0]["from_stop"] == asked[query]["start"] and steps[-1]["to_stop"] == asked[query]["goal"]
        assert steps[-1]["arrival_secs"] <= asked[query]["deadline_secs"]
        assert all(a["to_stop"] == b["from_stop"] and a["arrival_secs"] <= b["departure_secs"] for a, b in zip(steps, steps[1:]))
        assert all((int(s["trip_id"]), s["from_stop"], s["departure_secs"]) in rides for s in steps if s["type"] == "ride")


def test_unbounded_profile_against_forward_scans(spark, small):
    """Every pair is the best arrival from its departure, without a later departure that arrives no later."""
    got = defaultdict(list)
    for r in QUERIES["d27_unbounded_profile"](spark, small).collect():
        got[r["query_id"]].append((r["departure_secs"], r["arrival_secs"]))
    assert got
    for pairs in got.values():
        pairs.sort()
        assert all(a < b and x < y for (a, x), (b, y) in zip(pairs, pairs[1:]))
    best = {r["query_id"]: r["departure_secs"] for r in QUERIES["d28_latest_departure"](spark, small).collect()}
    assert all(max(p)[0] == best[query] for query, p in got.items() if query in best)
