"""Tables that are written and kept, and the remaining evaluation and planning queries."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from slackline.functions import clock
from slackline.operators import evaluation, features, lifecycle, routes, timetable, walks
from slackline.plans import scan
from slackline.queries.domain import _network, _queries
from slackline.queries.registry import query, scratch
from slackline.queries.relational import _KM, R4
from slackline.sources import tables
from slackline.sources.roles import OBSERVATIONS, STOP_TIMES, STOPS, observations, stop_times, stops
from slackline.sources.tables import read


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s2_format_load(spark, d):
    """A table by format name and path, as a lake table is loaded."""
    return spark.read.format("parquet").load(f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def s10_create_once(spark, d):
    """A derived table that is made once, kept on the second call and made anew when forced."""
    path = scratch(spark, "derived")
    name = f"slackline_derived_{path.rsplit('-', 1)[-1]}"
    rows = read(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    tables.create_once(spark, name, rows.limit(0), path=path)
    kept = tables.create_once(spark, name, rows, path=path)
    if not kept.isEmpty():
        raise RuntimeError("a table that was there was made again")
    return tables.create_once(spark, name, rows, force=True, path=path)


@query(f"WITH {OBSERVATIONS} SELECT operating_day, count(*) AS n FROM obs WHERE operating_day BETWEEN DATE '2023-12-28' AND DATE '2024-01-10' GROUP BY 1", days=("operating_day",))
def s7_day_range(spark, d):
    """Daily folders of a range whose first days aren't there."""
    import datetime

    path = scratch(spark, "days")
    tables.write_partitions(observations(spark, d).withColumn("day", F.col("operating_day")), path, ["day"], dynamic=False)
    rows = tables.read_range(spark, path, datetime.date(2023, 12, 28), datetime.date(2024, 1, 10))
    return rows.groupBy("operating_day").agg(F.count("*").alias("n"))


@query("SELECT name, EXISTS (SELECT 1 FROM information_schema.tables WHERE table_name = name) AS there FROM (VALUES ('part'), ('no_such_table')) t(name)")
def s11_table_exists(spark, d):
    read(spark, d, "part").createOrReplaceTempView("part")
    return spark.createDataFrame([(n, tables.exists(spark, n)) for n in ("part", "no_such_table")], "name string, there boolean")


@query("SELECT count(*) AS n, sum(c_acctbal)::DOUBLE > 0 AS in_credit, TRUE AS within FROM customer")
def s18_batched_upload(spark, d):
    """A table dropped and written again in files of at most 400 rows."""
    from pyspark.sql import types as T

    path = scratch(spark, "upload")
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_acctbal", T.DoubleType())])
    for _ in range(2):
        tables.upload(read(spark, d, "customer"), path, schema, 400)
    by_file = spark.read.schema(schema).parquet(path).groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"))
    return by_file.agg(F.sum("n").alias("n"), (F.sum("total") > 0).alias("in_credit"), (F.max("n") <= 400).alias("within"))


@query("SELECT * FROM (VALUES (1, 'a', 0.5::DOUBLE), (2, 'b', 1.5::DOUBLE)) t(k, v, x)")
def s21_local_frame(spark, d):
    import pandas as pd

    return tables.from_local(spark, pd.DataFrame({"k": [1, 2], "empty": [None, None], "v": ["a", "b"], "x": [0.5, 1.5]}))


@query("SELECT r_regionkey, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY 1")
def s26_temp_view(spark, d):
    """A view that a second definition replaces."""
    r = read(spark, d, "region")
    r.createOrReplaceTempView("slackline_regions")
    r.filter("r_name <> 'ASIA'").createOrReplaceTempView("slackline_regions")
    read(spark, d, "nation").createOrReplaceTempView("slackline_nations")
    return spark.sql("SELECT r_regionkey, count(*) AS n FROM slackline_nations JOIN slackline_regions ON n_regionkey = r_regionkey GROUP BY 1")


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def s12_copy_since(spark, d):
    """A copy of a shared table from a day on, partitioned by year."""
    path = scratch(spark, "copy")
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))
    tables.write_partitions(o.withColumn("part_year", F.year("o_orderdate")), path, ["part_year"], dynamic=False)
    return spark.read.parquet(path).drop("part_year").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1")
def s15_partition_read(spark, d):
    """One partition of a table by year: the filter on the folder column prunes the rest."""
    path = scratch(spark, "years")
    li = read(spark, d, "lineitem", "l_returnflag", "l_shipdate").withColumn("part_year", F.year("l_shipdate"))
    tables.write_partitions(li, path, ["part_year"], dynamic=False)
    return spark.read.parquet(path).filter("part_year = 1997").drop("part_year").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT 2 * count(*) AS n FROM supplier")
def s16_overwrite_append(spark, d):
    path = scratch(spark, "append")
    s = read(spark, d, "supplier", "s_suppkey")
    s.write.mode("overwrite").parquet(path)
    s.write.mode("append").parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query(f"WITH {OBSERVATIONS} SELECT bpuic, transport, hour, quantile_disc(delay, 0.9) AS p90 FROM obs GROUP BY 1, 2, 3")
def s19_lookup_table(spark, d):
    """A lookup kept as a table with real key columns, not as text keys."""
    path = scratch(spark, "lookup")
    features.history(observations(spark, d), ["bpuic", "transport", "hour"], "delay", "h").write.parquet(path)
    return spark.read.parquet(path).select("bpuic", "transport", "hour", F.col("h_p90").alias("p90"))


@query("SELECT * FROM (VALUES (1, 'a', DATE '2024-01-01'), (2, NULL, DATE '2024-01-02')) t(k, v, day)", days=("day",))
def s20_driver_rows(spark, d):
    import datetime

    return spark.createDataFrame([(1, "a", datetime.date(2024, 1, 1)), (2, None, datetime.date(2024, 1, 2))], "k int, v string, day date")


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def s24_stored_view(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    n.join(r, n["n_regionkey"] == r["r_regionkey"]).createOrReplaceTempView("slackline_nation_region")
    return spark.sql("SELECT r_name, count(*) AS n FROM slackline_nation_region GROUP BY r_name")


@query("SELECT column_name AS col_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END AS data_type FROM information_schema.columns WHERE table_name = 'part'")
def s25_catalog(spark, d):
    read(spark, d, "part").createOrReplaceTempView("slackline_part")
    return spark.sql("DESCRIBE slackline_part").select("col_name", "data_type")


@query("SELECT round(sqrt(avg((40 - value) * (40 - value))) + 1e-9, 4) AS rmse, round(avg(abs(40 - value)) + 1e-9, 4) AS mae, round(avg(40 - value) + 1e-9, 4) AS bias FROM events")
def a13_point_metrics(spark, d):
    m = evaluation.regression_metrics(read(spark, d, "events", "value").withColumn("p", F.lit(40.0)), "value", "p")
    return m.select(R4("rmse").alias("rmse"), R4("mae").alias("mae"), R4("bias").alias("bias"))


_FRONT = f"WITH {OBSERVATIONS}, t AS (SELECT transport, hour, quantile_disc(delay, 0.5) AS a, quantile_disc(delay, 0.8) AS b, quantile_disc(delay, 0.95) AS c FROM obs WHERE operating_day < DATE '2024-01-16' GROUP BY 1, 2), v AS (SELECT delay, a, b, c FROM obs JOIN t USING (transport, hour) WHERE operating_day >= DATE '2024-01-16') "
_FRONT += " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round(avg(CASE WHEN {c} >= delay THEN 1.0::DOUBLE ELSE 0 END) + 1e-9, 4) AS success, round(avg({c}) / 60 + 1e-9, 4) AS mean_buffer_min FROM v" for q, c in ((0.5, "a"), (0.8, "b"), (0.95, "c")))


@query(_FRONT)
def a36_reliability_frontier(spark, d):
    """Success against time paid, level by level, on rows the lookup hasn't seen."""
    o = observations(spark, d)
    t = features.history(o.filter("operating_day < '2024-01-16'"), ["transport", "hour"], "delay", "h", (0.5, 0.8, 0.95))
    c = evaluation.calibration(o.filter("operating_day >= '2024-01-16'").join(t, ["transport", "hour"]), "delay", {0.5: "h_p50", 0.8: "h_p80", 0.95: "h_p95"})
    return c.select("q", R4("success").alias("success"), R4("mean_buffer_min").alias("mean_buffer_min"))


@query(f"WITH {OBSERVATIONS}, t AS (SELECT quantile_disc(delay, 0.5) AS a, quantile_disc(delay, 0.9) AS b FROM obs WHERE operating_day < DATE '2024-01-16') SELECT round(sqrt(avg(pow(a - delay, 2))) + 1e-9, 4) AS rmse, round(avg(abs(a - delay)) + 1e-9, 4) AS mae, round(avg(CASE WHEN delay >= b THEN 0.9 * (delay - b) ELSE (1 - 0.9) * (b - delay) END) + 1e-9, 4) AS pinball_90 FROM obs, t WHERE operating_day >= DATE '2024-01-16'")
def d56_holdout(spark, d):
    o = observations(spark, d)
    v = o.filter("operating_day >= '2024-01-16'").join(features.overall(o.filter("operating_day < '2024-01-16'"), "delay", (0.5, 0.9)))
    m = evaluation.regression_metrics(v, "delay", "all_p50").join(evaluation.pinball_losses(v, "delay", {0.9: "all_p90"}))
    return m.select(R4("rmse").alias("rmse"), R4("mae").alias("mae"), R4("pinball_90").alias("pinball_90"))


@query("SELECT p_partkey, p_size AS departure_secs, p_partkey % 3 AS n_transfers FROM part ORDER BY p_size DESC, p_partkey % 3, p_partkey LIMIT 20")
def o3_route_order(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").alias("departure_secs"), (F.col("p_partkey") % 3).alias("n_transfers"), F.col("p_partkey").alias("total_walk_m"))
    return routes.best_first(p).limit(20).select("p_partkey", "departure_secs", "n_transfers")


@query(f"WITH {OBSERVATIONS} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS seq, count(*) OVER (PARTITION BY user_id)::INTEGER AS length FROM obs")
def w11_older_sequence(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    return observations(spark, d).select("event_id", F.row_number().over(w.orderBy("ts", "event_id")).alias("seq"), F.count("*").over(w).cast("int").alias("length"))


@query(None)
def d26_latest_routes(spark, d):
    """Routes by latest departure without asking for a probability."""
    c, w = _network(spark, d)
    return scan.plan_routes(c.drop("quantiles"), w, _queries(spark, d, 30, c).withColumn("q", F.lit(0.0)), max_walk=12_000.0).select("query_id", "route_rank", "departure_secs", "arrival_secs", "n_transfers")


@query(None)
def d30_candidates(spark, d):
    """Candidates first, judged afterwards: plan without probabilities, annotate every ride, keep what passes."""
    c, w = _network(spark, d)
    asked = _queries(spark, d, 30, c)
    found = scan.plan_routes(c, w, asked.withColumn("q", F.lit(0.0)), max_walk=12_000.0).join(asked.select("query_id", "deadline_secs"), "query_id")
    q = features.history(observations(spark, d), ["bpuic"], "delay", "h")
    steps = found.select("query_id", "route_rank", "deadline_secs", F.posexplode("steps").alias("i", "s")).select("query_id", "route_rank", "deadline_secs", "i", "s.*").withColumn("bpuic", F.col("to_stop"))
    known = steps.join(q.select("bpuic", F.array(*[F.col(n) for n in features.level_names("h")]).alias("quantiles")), "bpuic", "left")
    step = F.struct("i", "type", "trip_id", F.lit("L").alias("line_text"), "from_stop", "to_stop", "departure_secs", "arrival_secs", (F.col("arrival_secs") - F.col("departure_secs")).alias("duration_sec"), "quantiles")
    again = known.groupBy("query_id", "route_rank", "deadline_secs").agg(F.array_sort(F.collect_list(step)).alias("all"))
    again = again.withColumn("steps", F.transform("all", lambda s: F.struct(*[s[n].alias(n) for n in ("type", "trip_id", "line_text", "from_stop", "to_stop", "departure_secs", "arrival_secs", "duration_sec", "quantiles")])))
    judged = routes.annotate(again, 0.75)
    return judged.filter("passes_confidence").select("query_id", "route_rank", F.round("route_confidence", 6).alias("route_confidence"), "robust_arrival_time")


@query("SELECT 'green' AS active, 'blue' AS idle, true AS due")
def d44_slots(spark, d):
    import datetime

    path = scratch(spark, "slots")
    lifecycle.save_state(spark, lifecycle.State("green", datetime.date(2025, 1, 1), datetime.date(2026, 1, 31)), path)
    s = lifecycle.load_state(spark, path)
    return spark.createDataFrame([(s.active, s.idle, s.due(datetime.date(2026, 2, 7)))], "active string, idle string, due boolean")


@query(f"WITH {STOP_TIMES}, c AS (SELECT trip_id, stop_sequence, stop FROM st), {OBSERVATIONS}, q AS (SELECT bpuic, quantile_disc(delay, 0.9) AS p90 FROM obs GROUP BY 1) SELECT trip_id, stop_sequence::INTEGER AS stop_sequence, coalesce(p90, 0.0) AS predicted FROM c LEFT JOIN q ON bpuic = stop")
def d51_add_delays(spark, d):
    """Every ride's predicted delay at a probability, from the lookup by stop."""
    from slackline.functions import quantiles as Q

    q = observations(spark, d).groupBy(F.col("bpuic").alias("stop")).agg(Q.exact_percentiles(F.col("delay")).alias("quantiles"))
    s = routes.attach_quantiles(stop_times(spark, d), [(q, ["stop"])])
    return s.select("trip_id", "stop_sequence", F.coalesce(Q.at_level(F.col("quantiles"), F.lit(0.9)), F.lit(0.0)).alias("predicted"))


@query(None)
def d64_two_phase(spark, d):
    """A probe without probabilities finds the queries that have any route; only those are scanned with them."""
    c, w = _network(spark, d)
    asked = _queries(spark, d, 30, c)
    probe = scan.plan_routes(c.drop("quantiles"), w, asked.withColumn("q", F.lit(0.0)), max_walk=12_000.0, max_routes=1).select("query_id").distinct()
    return scan.plan_routes(c, w, asked.join(probe, "query_id", "left_semi"), max_walk=12_000.0, max_routes=2).select("query_id", "route_rank", "departure_secs", "arrival_secs")


@query("SELECT i AS round, 100.0::DOUBLE / i AS loss FROM range(1, 51) t(i)")
def d66_loss_curve(spark, d):
    path = scratch(spark, "curve")
    spark.range(1, 51).select(F.col("id").alias("round"), (F.lit(100.0) / F.col("id")).alias("loss")).write.parquet(path)
    return spark.read.parquet(path)


@query(None)
def d67_timings(spark, d):
    """Named timings and their statistics."""
    taken = []
    for name, work in (("scan", lambda: read(spark, d, "events").count()), ("connections", lambda: timetable.build_connections(stop_times(spark, d)).count())):
        began = time.perf_counter()
        work()
        taken.append((name, (time.perf_counter() - began) * 1000))
    return evaluation.latency_stats(spark.createDataFrame(taken, "name string, ms double"), "ms", ["name"])


@query(f"WITH {OBSERVATIONS}, f AS (SELECT event_id, transport, hour, dow, month, coalesce(nullif(bpuic % 7, 0), 0)::DOUBLE AS x FROM obs) SELECT event_id, transport, hour::VARCHAR AS hour, dow::VARCHAR AS dow, month::VARCHAR AS month, x FROM f")
def m7_feature_row(spark, d):
    from slackline.functions.cleaning import ml_columns

    o = observations(spark, d).select("event_id", "transport", "hour", "dow", "month", F.nullif(F.col("bpuic") % 7, F.lit(0)).alias("x"), "delay")
    return ml_columns(o, ["transport", "hour", "dow", "month"], ["x"], "delay").select("event_id", "transport", "hour", "dow", "month", "x")


_NEAR = f"{STOPS}, near AS (SELECT a.stop AS a, b.stop AS b, 1000 * {_KM} AS metres FROM stops a, stops b WHERE a.stop <> b.stop AND 1000 * {_KM} <= 9000)"


@query(f"WITH {_NEAR} SELECT a, b, round(metres, 3) AS line FROM near WHERE (a + b) % 7 = 0 AND metres > 0.9 * metres + 5")
def j32_crow_fly(spark, d):
    """Walks that are shorter than the straight line: those that were given too short a distance here."""
    w = walks.straight_footpaths(stops(spark, d), 9000.0, 1000.0, 1.0)
    given = w.withColumn("distance", F.when((F.col("a") + F.col("b")) % 7 == 0, 0.9 * F.col("distance")).otherwise(F.col("distance") + 1))
    return walks.too_short(given, stops(spark, d)).select("a", "b", F.round("line", 3).alias("line"))


@query(f"WITH {STOP_TIMES}, x AS (SELECT trip_id AS query_id, arr_secs AS departure_secs, arr_secs + stop * 60 AS arrival_secs FROM st) SELECT DISTINCT * FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.query_id = x.query_id AND y.departure_secs >= x.departure_secs AND y.arrival_secs <= x.arrival_secs AND (y.departure_secs > x.departure_secs OR y.arrival_secs < x.arrival_secs))")
def d9_pareto_insert(spark, d):
    p = stop_times(spark, d).select(F.col("trip_id").alias("query_id"), F.col("arr_secs").alias("departure_secs"), (F.col("arr_secs") + F.col("stop") * 60).alias("arrival_secs"))
    return routes.inserted(p, "query_id")


@query(None)
def d20_reconstruct_route(spark, d):
    """The steps of each route, followed from where one boards to where one changes."""
    c, w = _network(spark, d)
    found = scan.plan_routes(c, w, _queries(spark, d, 30, c), max_walk=12_000.0)
    return found.select("query_id", "route_rank", F.posexplode("steps").alias("step_index", "s")).select("query_id", "route_rank", "step_index", "s.*")


@query(None)
def d27_unbounded_profile(spark, d):
    """(departure, arrival) pairs of each query that no other beats, whatever the delays."""
    c, w = _network(spark, d)
    asked = _queries(spark, d, 30, c).withColumn("q", F.lit(0.0))
    return routes.pareto(scan.plan_routes(c.drop("quantiles"), w, asked, max_walk=12_000.0, max_routes=1_000_000), "query_id")


_PLANNED = "pl AS (SELECT trip_id, stop, trip_id % 3 AS agency, stop_sequence, arr_secs % 86400 AS clock FROM st), ob AS (SELECT trip_id AS obs_trip, stop, trip_id % 3 AS agency, CASE WHEN stop_sequence > 1 THEN arr_secs % 86400 END AS a, CASE WHEN stop_sequence % 4 <> 0 THEN arr_secs % 86400 END AS d, trip_id % 7 AS weekday FROM st)"


@query(f"""WITH {STOP_TIMES}, {_PLANNED}, met AS (SELECT obs_trip, trip_id, pl.stop, stop_sequence, (trip_id + weekday) % 3 <> 0 AS runs FROM ob JOIN pl ON ob.stop = pl.stop AND ob.agency = pl.agency AND (a IS NULL OR a = clock) AND (d IS NULL OR d = clock)),
  fs AS (SELECT obs_trip, trip_id, min(stop_sequence) AS s0 FROM met GROUP BY 1, 2), ok AS (SELECT DISTINCT met.obs_trip, met.trip_id FROM met JOIN fs ON met.obs_trip = fs.obs_trip AND met.trip_id = fs.trip_id AND stop_sequence = s0 WHERE runs),
  dm AS (SELECT met.* FROM met JOIN ok USING (obs_trip, trip_id)), n1 AS (SELECT obs_trip, count(DISTINCT stop) AS n FROM dm GROUP BY 1), n2 AS (SELECT obs_trip, trip_id, count(DISTINCT stop) AS m FROM dm GROUP BY 1, 2)
  SELECT n2.obs_trip, n2.trip_id FROM n2 JOIN n1 USING (obs_trip) WHERE n = m""")
def d39_match_trips(spark, d):
    """All observed trips against all planned ones: clocks, then the first stop's day, then every stop."""
    st = stop_times(spark, d)
    agency, at = (F.col("trip_id") % 3).alias("agency"), F.col("arr_secs")
    runs = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: (F.col("trip_id") + k) % 3 != 0)
    planned = st.select("trip_id", "stop", agency, "stop_sequence", at.alias("arr"), at.alias("dep"), runs.alias("runs"))
    seen = at % clock.DAY
    observed = st.select(F.col("trip_id").alias("obs_trip"), "stop", agency, F.when(F.col("stop_sequence") > 1, seen).alias("arr"), F.when(F.col("stop_sequence") % 4 != 0, seen).alias("dep"), (F.col("trip_id") % 7).cast("int").alias("weekday"))
    return features.match_trips(planned, observed)


_LEVELS = ((0.5, "a"), (0.8, "b"), (0.95, "c"))
_SHARES = " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, avg({c} / 60) AS minutes, avg(CASE WHEN {c} >= delay THEN 1.0::DOUBLE ELSE 0 END) AS success FROM v" for q, c in _LEVELS)


@query(f"WITH {OBSERVATIONS}, t AS (SELECT transport, hour, quantile_disc(delay, 0.5) AS a, quantile_disc(delay, 0.8) AS b, quantile_disc(delay, 0.95) AS c FROM obs WHERE operating_day < DATE '2024-01-16' GROUP BY 1, 2), v AS (SELECT delay, a, b, c FROM obs JOIN t USING (transport, hour) WHERE operating_day >= DATE '2024-01-16'), f AS ({_SHARES}) SELECT q, round(minutes + 1e-9, 4) AS minutes, round(success + 1e-9, 4) AS success, NOT EXISTS (SELECT 1 FROM f g WHERE g.minutes <= f.minutes AND g.success >= f.success AND (g.minutes < f.minutes OR g.success > f.success)) AS efficient FROM f")
def d55_frontier(spark, d):
    """Predicted minutes against success by level, on rows the lookup hasn't seen, and the levels worth their time."""
    o = observations(spark, d)
    t = features.history(o.filter("operating_day < '2024-01-16'"), ["transport", "hour"], "delay", "h", (0.5, 0.8, 0.95))
    v = o.filter("operating_day >= '2024-01-16'").join(t, ["transport", "hour"])
    levels = F.array(*[F.struct(F.lit(q).alias("q"), F.col(c).alias("p")) for q, c in ((0.5, "h_p50"), (0.8, "h_p80"), (0.95, "h_p95"))])
    long = v.select("delay", F.inline(levels)).select("q", (F.col("p") / 60).alias("minutes"), (F.col("p") >= F.col("delay")).alias("success"))
    f = evaluation.frontier(long, "q", "minutes", "success")
    return f.select("q", R4("minutes").alias("minutes"), R4("success").alias("success"), "efficient")


@query(f"WITH {_NEAR} SELECT a, count(*) AS n, round(sum(1 + metres / 1000), 3) AS minutes FROM near GROUP BY 1")
def d57_footpaths_once(spark, d):
    """The footpaths' table, made by the first call and only read by the second."""
    path = scratch(spark, "footpaths-table")
    name = f"slackline_footpaths_{path.rsplit('-', 1)[-1]}"
    for _ in range(2):
        made = tables.create_once(spark, name, walks.straight_footpaths(stops(spark, d), 9000.0, 1000.0, 1.0), path=path)
    return made.groupBy("a").agg(F.count("*").alias("n"), F.round(F.sum("walk_time_min"), 3).alias("minutes"))


@query(f"""WITH {STOP_TIMES}, g AS (SELECT *, CASE WHEN stop_sequence > 1 AND stop % 3 = lag(stop % 3) OVER w THEN 0 ELSE 1 END AS fresh FROM st WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS grp FROM g),
  r AS (SELECT trip_id, grp, arg_min(stop, stop_sequence) AS f, arg_max(stop, stop_sequence) AS t, max(arr_secs) AS arr FROM s GROUP BY 1, 2), n AS (SELECT *, lead(f) OVER (PARTITION BY trip_id ORDER BY grp) AS nf FROM r)
  SELECT trip_id AS route, count(*) AS rides, count(*) FILTER (WHERE nf <> t) AS walks, sum(CASE WHEN nf <> t THEN arr ELSE 0 END)::BIGINT AS left_at FROM n GROUP BY 1""")
def d65_route_forms(spark, d):
    """Steps of rides to routes and back to steps: rides of one trip fused, walks filled in."""
    st = stop_times(spark, d)
    s = st.select(F.col("trip_id").alias("route"), F.col("stop_sequence").alias("step_index"), F.lit("ride").alias("type"), (F.col("stop") % 3).cast("string").alias("trip_id"), F.col("stop").alias("from_stop"), F.col("stop").alias("to_stop"), F.col("arr_secs").alias("departure_secs"), F.col("arr_secs").alias("arrival_secs"))
    steps = routes.step_table(routes.from_rides(routes.merge_rides(s, "route"), "route", F.lit(60)), "route")
    on_foot = F.col("type") == "walk"
    return steps.groupBy("route").agg(F.count_if(~on_foot).alias("rides"), F.count_if(on_foot).alias("walks"), F.sum(F.when(on_foot, F.col("departure_secs")).otherwise(0)).alias("left_at"))


@query(f"WITH {OBSERVATIONS}, t AS (SELECT transport, row_number() OVER (ORDER BY count(*) DESC, transport) - 1 AS k FROM obs WHERE transport <> 'click' GROUP BY 1) SELECT event_id, coalesce(k, (SELECT count(*) FROM t))::DOUBLE AS transport_idx, round(greatest((delay - 50) * 60, 0.0) + 1e-9, 4) AS predicted_secs FROM obs LEFT JOIN t USING (transport)")
def m5_unknown_labels(spark, d):
    """A saved indexer on rows of a kind it has never met, and minutes as seconds, none below 0."""
    from pyspark.ml import Pipeline

    from slackline.operators import models

    o = observations(spark, d).select("event_id", "transport", "delay")
    path = scratch(spark, "indexer")
    models.save(Pipeline(stages=models.feature_stages(["transport"], ["delay"])).fit(o.filter("transport <> 'click'")), path)
    out = models.load(path).transform(o)
    return out.select("event_id", "transport_idx", R4(F.greatest((F.col("delay") - 50) * 60, F.lit(0.0))).alias("predicted_secs"))
