"""Projections, filters, joins, aggregations, windows, order, sets and table upkeep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slackline.functions import clock, geo
from slackline.functions import cleaning as C
from slackline.operators import evaluation, features, journeys, timetable
from slackline.queries.registry import query, scratch
from slackline.sources import tables
from slackline.sources.roles import OBSERVATIONS, STATIONS, STOP_TIMES, STOPS, observations, stations, stop_times, stops
from slackline.sources.tables import read

def R4(c):
    """Four digits; a hair above, so that halves go up in both engines."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 4)



# --- sources and sinks ----------------------------------------------------------------------------


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity) + 1e-9, 4) AS quantity FROM lineitem GROUP BY 1")
def s1_scan(spark, d):
    return read(spark, d, "lineitem", "l_returnflag", "l_quantity").groupBy("l_returnflag").agg(F.count("*").alias("n"), R4(F.sum("l_quantity")).alias("quantity"))


@query("SELECT n_regionkey, count(*) AS n, max(n_name) AS last FROM nation GROUP BY 1")
def s4_csv_header(spark, d):
    path = scratch(spark, "csv")
    read(spark, d, "nation").write.option("header", True).csv(path)
    return tables.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.max("n_name").alias("last"))


@query("SELECT CAST(r_regionkey AS INTEGER) AS r_regionkey, r_name FROM region")
def s5_csv_inferred(spark, d):
    path = scratch(spark, "csv")
    read(spark, d, "region").write.option("header", True).csv(path)
    return tables.read_csv(spark, path)


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS operating_day, CAST(user_id AS VARCHAR) AS trip_id, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-04' GROUP BY 1, 2")
def s6_source_days(spark, d):
    """Three days written as the source publishes them, read as a range and renamed; the unknown column goes."""
    path = scratch(spark, "days")
    e = observations(spark, d).filter(F.col("operating_day").between("2024-01-02", "2024-01-04"))
    source = e.select(F.col("operating_day").cast("string").alias("BETRIEBSTAG"), F.col("user_id").cast("string").alias("FAHRT_BEZEICHNER"), F.lit("x").alias("UNBEKANNT_NEU"), F.dayofmonth("operating_day").alias("day"))
    source.write.partitionBy("day").option("header", True).option("sep", ";").csv(path)
    rows = tables.read_days(spark, [f"{path}/day={k}" for k in (2, 3, 4)])
    return rows.groupBy("operating_day", "trip_id").agg(F.count("*").alias("n"))


@query("SELECT h AS found, min(page_id) AS page_id FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([A-Za-z]+)\"', 1)) AS h FROM pages) GROUP BY 1")
def s8_resource_index(spark, d):
    return tables.resource_index(read(spark, d, "pages", "page_id", "html"), 'href="/([A-Za-z]+)"')


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2")
def s9_sql_view(spark, d):
    for t in ("nation", "region"):
        read(spark, d, t).createOrReplaceTempView(f"slackline_{t}")
    return spark.sql("SELECT n_name, r_name FROM slackline_nation JOIN slackline_region ON n_regionkey = r_regionkey WHERE r_regionkey = 2")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2)::DOUBLE AS total FROM orders GROUP BY 1")
def s13_append_cast(spark, d):
    """Two appends whose columns come in another order and type than the table declares."""
    from pyspark.sql import types as T

    path = scratch(spark, "append")
    declared = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DecimalType(18, 2)), T.StructField("o_orderpriority", T.StringType())])
    orders = read(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderpriority")
    even = F.col("o_orderkey") % 2 == 0
    tables.append(orders.filter(even).select("o_orderpriority", F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderkey"), path, declared)
    tables.append(orders.filter(~even), path, declared)
    return spark.read.schema(declared).parquet(path).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).cast("double").alias("total"))


@query("SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) <> 1996 OR month(o_orderdate) <= 6 GROUP BY 1")
def s14_dynamic_overwrite(spark, d):
    """A year's partition is replaced by its first half; the other years stay."""
    path = scratch(spark, "parts")
    o = read(spark, d, "orders", "o_orderkey", "o_orderdate").withColumn("part_year", F.year("o_orderdate"))
    tables.write_partitions(o, path, ["part_year"], dynamic=False)
    tables.write_partitions(o.filter("part_year = 1996 and month(o_orderdate) <= 6"), path, ["part_year"])
    kept = spark.read.parquet(path).drop("part_year")
    return kept.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS keys FROM nation")
def s17_single_csv(spark, d):
    path = scratch(spark, "report")
    tables.write_single_csv(read(spark, d, "nation"), path)
    return tables.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))


@query("WITH x AS (SELECT CAST(ts AS DATE) AS d, value FROM events) SELECT d, count(*) AS n FROM x WHERE d NOT IN (SELECT DISTINCT d FROM x ORDER BY d LIMIT 7) GROUP BY 1", days=("d",))
def s22_retention(spark, d):
    return tables.retain(observations(spark, d).select("operating_day"), "operating_day", 7).groupBy(F.col("operating_day").alias("d")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 48 >= 24 THEN (dayofweek(o_orderdate) + 1) % 7 ELSE dayofweek(o_orderdate) END::INTEGER AS dow,
  lpad(((o_orderkey % 48) % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || ':00' AS wrapped FROM orders""")
def s23_roll_weekday(spark, d):
    """Rows whose clock passes 24:00 move to the next weekday and their clock wraps: an update as a projection."""
    o = read(spark, d, "orders", "o_orderkey", "o_orderdate")
    h, dow = F.col("o_orderkey") % 48, F.dayofweek("o_orderdate") - 1
    text = clock.clock_text(h * 3600 + (F.col("o_orderkey") % 60) * 60)
    return o.select("o_orderkey", F.when(h >= 24, (dow + 1) % 7).otherwise(dow).cast("int").alias("dow"), clock.clock_text(clock.clock_seconds(text), wrap=True).alias("wrapped"))


@query("""SELECT n_regionkey, 'region_' || substr(sha1(string_agg(u, ',' ORDER BY u)), 1, 12) AS region_key
  FROM (SELECT DISTINCT n_regionkey, n_name AS u FROM nation) GROUP BY 1""")
def s30_region_key(spark, d):
    n = read(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.concat(F.lit(" "), F.col("n_name"))).alias("u"))
    return n.select("n_regionkey", tables.region_key(F.col("u")).alias("region_key"))


# --- projections and filters ------------------------------------------------------------------------


@query("SELECT event_id, value FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def p1_date_range(spark, d):
    # bounds on the stored column itself, so that the scan can skip row groups
    e = read(spark, d, "events", "event_id", "ts", "value")
    return e.filter((F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00"))) & (F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")))).select("event_id", "value")


@query("SELECT s_suppkey FROM supplier WHERE CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END IS DISTINCT FROM true")
def p2_not_failed(spark, d):
    failed = F.when(F.col("s_suppkey") % 3 == 0, F.lit(True)).when(F.col("s_suppkey") % 3 == 1, F.lit(False))
    return read(spark, d, "supplier").filter(C.not_failed(failed)).select("s_suppkey")


@query("SELECT c_custkey FROM customer WHERE nullif(c_nationkey % 5, 0) IS NOT NULL AND nullif(c_custkey % 7, 0) IS NOT NULL")
def p3_not_null(spark, d):
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    return c.filter(F.nullif(F.col("c_nationkey") % 5, F.lit(0)).isNotNull() & F.nullif(F.col("c_custkey") % 7, F.lit(0)).isNotNull()).select("c_custkey")


@query("""SELECT o_orderkey, CASE WHEN trim(x) = '' THEN 'PROGNOSE' ELSE upper(trim(x)) END AS status
  FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '  ' WHEN o_orderstatus = 'F' THEN ' real ' ELSE 'Unbekannt' END AS x FROM orders) WHERE upper(trim(x)) <> 'UNBEKANNT'""")
def p4_status_clean(spark, d):
    x = F.when(F.col("o_orderstatus") == "P", "  ").when(F.col("o_orderstatus") == "F", " real ").otherwise("Unbekannt")
    return read(spark, d, "orders").select("o_orderkey", C.status(x).alias("status")).filter("status <> 'UNBEKANNT'")


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click')")
def p5_membership(spark, d):
    return read(spark, d, "events", "event_id", "event_type").filter(F.col("event_type").isin("view", "click")).select("event_id")


@query("SELECT c_custkey FROM customer WHERE CAST(c_custkey AS VARCHAR) LIKE '85%'")
def p6_prefix(spark, d):
    return read(spark, d, "customer", "c_custkey").filter(F.col("c_custkey").cast("string").startswith("85"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(^red|ring$)') AND NOT contains(p_name, 'small')")
def p7_regex(spark, d):
    return read(spark, d, "part", "p_partkey", "p_name").filter(F.col("p_name").rlike("(^red|ring$)") & ~F.col("p_name").contains("small"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'Bus' WHEN 'click' THEN 'Tram' WHEN 'error' THEN 'Train' ELSE 'Unknown' END AS mode,
  CASE event_type WHEN 'view' THEN 'BUS' WHEN 'click' THEN 'TRAM' WHEN 'error' THEN 'ZUG' ELSE upper(event_type) END AS product FROM events""")
def p8_mode_mapping(spark, d):
    t = F.col("event_type")
    code = F.when(t == "view", " bus ").when(t == "click", "t").when(t == "error", "Ice").otherwise(t)
    return read(spark, d, "events").select("event_id", C.mode_group(code).alias("mode"), C.product(code, t).alias("product"))


@query("SELECT event_id, value - 30 AS raw, least(greatest(value - 30, 0), 60) AS label FROM events")
def p9_label_clamp(spark, d):
    return read(spark, d, "events").select("event_id", (F.col("value") - 30).alias("raw"), C.label_minutes(F.col("value") - 30).alias("label"))


@query("SELECT p_partkey FROM part WHERE trim(CASE WHEN p_size % 4 = 0 THEN ' ' WHEN p_size % 4 = 1 THEN NULL ELSE p_type END) <> ''")
def p10_blank_rejection(spark, d):
    x = F.when(F.col("p_size") % 4 == 0, " ").when(F.col("p_size") % 4 == 1, F.lit(None)).otherwise(F.col("p_type"))
    return read(spark, d, "part").filter(C.present(x)).select("p_partkey")


@query("""SELECT p_partkey, coalesce(CAST(nullif(p_size % 5, 0) AS VARCHAR), 'UNKNOWN') AS cat, coalesce(CAST(nullif(p_size % 3, 0) AS DOUBLE), 0.0) AS num, CAST(p_size AS DOUBLE) AS label FROM part""")
def p11_ml_columns(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size") % 5, F.lit(0)).cast("string").alias("cat"), F.nullif(F.col("p_size") % 3, F.lit(0)).alias("num"), F.col("p_size").alias("label"))
    return C.ml_columns(p, ["cat"], ["num"], "label")


@query(f"WITH {OBSERVATIONS} SELECT event_id, CAST(floor(delay) AS BIGINT) AS delay_sec, round(floor(delay) / 60.0 + 1e-9, 4)::DOUBLE AS delay_min FROM obs")
def p12_delay(spark, d):
    o = observations(spark, d).withColumn("actual", F.timestamp_seconds(F.col("secs") + F.floor("delay")))
    s = C.delay_seconds(F.col("arr_time"), F.col("actual"))
    return o.select("event_id", s.alias("delay_sec"), R4(s / 60.0).alias("delay_min"))


@query(f"""WITH {OBSERVATIONS}, s AS (SELECT month, transport, CASE WHEN least(greatest(delay - 20, 0), 120) = 0 THEN 'NO DELAY' WHEN least(greatest(delay - 20, 0), 120) <= 3 THEN 'NORMAL DELAY' ELSE 'EXCESSIVE_DELAY' END AS severity FROM obs)
  SELECT month, transport, severity, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY month, transport) + 1e-9, 4) AS share FROM s GROUP BY 1, 2, 3""")
def p13_severity_share(spark, d):
    o = observations(spark, d).select("month", "transport", C.severity(F.col("delay") - 20).alias("severity"))
    w = Window.partitionBy("month", "transport")
    return o.groupBy("month", "transport", "severity").agg(F.count("*").alias("n")).withColumn("share", R4(F.col("n") / F.sum("n").over(w)))


@query(f"WITH {OBSERVATIONS} SELECT event_id, CASE transport WHEN 'view' THEN 'Train' WHEN 'click' THEN 'Bus' ELSE 'Unknown' END AS mode FROM obs")
def p14_mode_group(spark, d):
    return observations(spark, d).select("event_id", C.mode_group(F.col("transport"), {"Train": ("VIEW",), "Bus": ("CLICK",)}).alias("mode"))


@query(f"""WITH {OBSERVATIONS} SELECT event_id, CASE WHEN h >= 4 AND h < 6 THEN 'early_morning' WHEN h >= 6 AND h < 9 THEN 'morning_rush' WHEN h >= 9 AND h < 16 THEN 'midday' WHEN h >= 16 AND h < 19 THEN 'evening_rush'
  WHEN h >= 19 AND h < 22 THEN 'evening' ELSE 'night' END AS tod FROM (SELECT event_id, hour + CASE WHEN bpuic % 10 = 0 THEN 24 ELSE 0 END AS h FROM obs)""")
def p15_time_of_day(spark, d):
    return observations(spark, d).select("event_id", C.time_of_day(F.col("hour") + F.when(F.col("bpuic") % 10 == 0, 24).otherwise(0)).alias("tod"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'none' WHEN p_size * 40 < 300 THEN 'tight' WHEN p_size * 40 < 900 THEN 'normal' ELSE 'comfortable' END AS tightness FROM part")
def p16_tightness(spark, d):
    return read(spark, d, "part").select("p_partkey", C.tightness(F.col("p_size") * 40, F.col("p_size") % 4).alias("tightness"))


@query("SELECT event_id, CASE WHEN value <= 10 THEN 'on_time' WHEN value <= 50 THEN 'minor' WHEN value <= 100 THEN 'moderate' ELSE 'severe' END AS class FROM events")
def p17_delay_class(spark, d):
    return read(spark, d, "events").select("event_id", C.delay_class(F.when(F.col("value") <= 10, 60).when(F.col("value") <= 50, 300).when(F.col("value") <= 100, 600).otherwise(601)).alias("class"))


@query("SELECT o_orderkey, dayofweek(o_orderdate) IN (0, 6) AS weekend FROM orders")
def p18_weekend(spark, d):
    return read(spark, d, "orders").select("o_orderkey", C.is_weekend(F.col("o_orderdate")).alias("weekend"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 1 WHEN o_orderkey % 3 = 1 OR o_orderkey % 5 = 1 OR o_orderkey % 7 = 1 THEN 2 ELSE 0 END AS day_type FROM orders")
def p19_day_type(spark, d):
    k = lambda n: (F.col("o_orderkey") % n).cast("int")
    return read(spark, d, "orders").select("o_orderkey", C.day_type(k(2), k(3), k(5), k(7)).alias("day_type"))


@query("SELECT p_partkey, concat_ws('__', p_size % 4, p_type, nullif(p_brand, 'Brand#1')) AS stratum FROM part")
def p20_stratum(spark, d):
    return read(spark, d, "part").select("p_partkey", C.stratum(F.col("p_size") % 4, F.col("p_type"), F.nullif(F.col("p_brand"), F.lit("Brand#1"))).alias("stratum"))


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END, ''), CASE WHEN p_size % 2 = 0 THEN p_type END, p_brand) AS label FROM part")
def p21_coalesce_label(spark, d):
    short = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", C.line_label(short, F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.col("p_brand")).alias("label"))


@query("SELECT s_suppkey, CASE WHEN strpos(x, ':') = 0 THEN '85:' || x ELSE x END AS agency FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '11:' || s_suppkey ELSE CAST(s_suppkey AS VARCHAR) END AS x FROM supplier)")
def p22_conditional_prefix(spark, d):
    x = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("11:"), F.col("s_suppkey").cast("string"))).otherwise(F.col("s_suppkey").cast("string"))
    return read(spark, d, "supplier").select("s_suppkey", C.with_prefix(x).alias("agency"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, a AS arr FROM (SELECT *, l_orderkey % 86400 AS dep, (l_orderkey % 86400 + (l_partkey % 40) * 3600 - 3600) AS a FROM lineitem)
  WHERE a >= dep AND l_suppkey <> l_linenumber AND NOT (a - dep >= 86400 AND a - dep - 86400 <= 21600)""")
def p23_anomaly_filter(spark, d):
    li = read(spark, d, "lineitem").withColumn("dep", F.col("l_orderkey") % 86_400).withColumn("arr", F.col("dep") + (F.col("l_partkey") % 40) * 3600 - 3600)
    return li.filter(C.sound_edge(F.col("dep"), F.col("arr"), F.col("l_suppkey"), F.col("l_linenumber"))).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "arr")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN value ELSE 0.0 END AS value_bus FROM events")
def p24_bus_only(spark, d):
    return read(spark, d, "events").withColumns(C.only_for(F.col("event_type") == "click", ["value"], "_bus")).select("event_id", "value_bus")


@query("""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer) SELECT c_custkey, round(coalesce(bal, (SELECT avg(bal) FROM x)) + 1e-9, 4) AS bal FROM x""")
def p25_mean_impute(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("bal"))
    return C.fill_means(c, ["bal"]).select("c_custkey", R4("bal").alias("bal"))


@query("SELECT c_custkey, coalesce(o.n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def p26_constant_impute(spark, d):
    n = read(spark, d, "orders", "o_custkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read(spark, d, "customer", "c_custkey").join(n, "c_custkey", "left").na.fill(0, ["n"])


@query("SELECT event_id, round(value - 50 + 1e-9, 4) AS error FROM events WHERE value - 50 > 0")
def p27_under_prediction(spark, d):
    return read(spark, d, "events").select("event_id", R4(F.col("value") - 50).alias("error")).filter("error > 0")


# --- joins ------------------------------------------------------------------------------------------


@query(f"WITH {STOP_TIMES}, {STOPS} SELECT s.name, count(*) AS n FROM st JOIN stops s USING (stop) GROUP BY 1")
def j1_stop_times_stops(spark, d):
    return stop_times(spark, d).join(stops(spark, d), "stop").groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, dayofweek(o_orderdate) + 1 AS dow, count(*) AS n, round(sum(l_quantity) + 1e-9, 4) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def j2_trip_service(spark, d):
    t = read(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    j = read(spark, d, "lineitem", "l_orderkey", "l_quantity").join(t, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderstatus", F.dayofweek("o_orderdate").alias("dow")).agg(F.count("*").alias("n"), R4(F.sum("l_quantity")).alias("quantity"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(p.p_name, ''), CAST(l_partkey AS VARCHAR)) AS line, c.c_mktsegment AS service
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON l_partkey = p_partkey""")
def j3_calendar_routes(spark, d):
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o, c = read(spark, d, "orders", "o_orderkey", "o_custkey"), read(spark, d, "customer", "c_custkey", "c_mktsegment")
    p = read(spark, d, "part", "p_partkey", "p_name", "p_size").filter("p_size > 10")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.line_label(F.col("p_name"), F.lit(None).cast("string"), F.col("l_partkey").cast("string")).alias("line"), F.col("c_mktsegment").alias("service"))


@query("SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 8) AND l_partkey % 100 IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 8)")
def j4_semi_region(spark, d):
    known = read(spark, d, "supplier").filter("s_nationkey < 8").select(F.col("s_suppkey").alias("stop"))
    walks = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b")).distinct()
    return timetable.build_footpaths(walks, known).select("a", "b")


@query(f"WITH {OBSERVATIONS} SELECT event_id FROM obs JOIN (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal > 5000) ON s_suppkey = bpuic")
def j5_scope_stops(spark, d):
    scope = read(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").cast("int").alias("bpuic")).distinct()
    return observations(spark, d).join(scope, "bpuic", "left_semi").select("event_id")


_AREAS = "areas AS (SELECT * FROM (VALUES (1, 6.0, 7.2, 46.1, 46.6), (2, 7.2, 9.0, 46.0, 46.5), (3, 6.5, 8.0, 46.55, 47.0)) t(area, x0, x1, y0, y1))"


def _areas(spark):
    box = "array(named_struct('x', x0, 'y', y0), named_struct('x', x1, 'y', y0), named_struct('x', x1, 'y', y1), named_struct('x', x0, 'y', y1))"
    rows = spark.createDataFrame([(1, 6.0, 7.2, 46.1, 46.6), (2, 7.2, 9.0, 46.0, 46.5), (3, 6.5, 8.0, 46.55, 47.0)], "area int, x0 double, x1 double, y0 double, y1 double")
    return rows.select("area", F.expr(box).alias("ring"))


@query(f"WITH {STOPS}, {_AREAS} SELECT stop, area FROM stops, areas WHERE lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1")
def j6_point_in_polygon(spark, d):
    points = stops(spark, d).select("stop", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return geo.assign_areas(points, _areas(spark), "stop", "area")


@query(f"WITH {STOPS}, {_AREAS} SELECT area, count(DISTINCT stop) AS n FROM stops, areas WHERE lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1 GROUP BY 1")
def j8_district_stops(spark, d):
    points = stops(spark, d).select("stop", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return geo.assign_areas(points, _areas(spark), "stop", "area").groupBy("area").agg(F.count_distinct("stop").alias("n"))


@query(f"WITH {STOPS}, {_AREAS} SELECT stop, CASE min(area) WHEN 1 THEN 'VD' WHEN 2 THEN 'VS' ELSE 'FR' END AS canton FROM stops, areas WHERE lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1 GROUP BY 1")
def j7_stop_canton(spark, d):
    points = stops(spark, d).select("stop", F.col("lon").alias("x"), F.col("lat").alias("y"))
    first = geo.assign_areas(points, _areas(spark), "stop", "area").groupBy("stop").agg(F.min("area").alias("a"))
    return first.select("stop", F.when(F.col("a") == 1, "VD").when(F.col("a") == 2, "VS").otherwise("FR").alias("canton"))


_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"WITH {STOPS}, {STATIONS}, p AS (SELECT a.stop, b.station, {_KM} AS km FROM stops a, stations b) SELECT stop, station, round(km + 1e-9, 4) AS km FROM (SELECT *, row_number() OVER (PARTITION BY stop ORDER BY km, station) AS n FROM p) WHERE n = 1")
def j9_nearest_station(spark, d):
    return geo.nearest(stops(spark, d), stations(spark), "stop", "station").withColumn("km", R4("km"))


@query(f"WITH {STOPS}, {OBSERVATIONS} SELECT stop, lat, lon, coalesce(n, 0) AS n FROM stops LEFT JOIN (SELECT bpuic, count(*) AS n FROM obs GROUP BY 1) ON bpuic = stop")
def j10_left_aggregate(spark, d):
    n = observations(spark, d).groupBy(F.col("bpuic").alias("stop")).agg(F.count("*").alias("n"))
    return stops(spark, d).join(n, "stop", "left").select("stop", "lat", "lon", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {OBSERVATIONS}, w AS (SELECT user_id % 10 AS station, date_trunc('hour', ts) AS h, avg(delay) AS temp FROM obs GROUP BY 1, 2), j AS (SELECT event_id, transport, temp FROM obs LEFT JOIN w ON w.station = bpuic % 10 AND w.h = date_trunc('hour', ts))
  SELECT event_id, round(coalesce(temp, (SELECT avg(temp) FROM j)) + 1e-9, 4) AS temp, round(CASE WHEN transport = 'click' THEN coalesce(temp, (SELECT avg(temp) FROM j)) ELSE 0.0 END + 1e-9, 4) AS temp_bus FROM j""")
def j11_weather_hour(spark, d):
    o = observations(spark, d).withColumn("product", F.when(F.col("transport") == "click", "BUS").otherwise("TRAM"))
    weather = o.groupBy((F.col("user_id") % 10).cast("int").alias("station"), F.date_trunc("hour", "ts").alias("hour_start")).agg(F.avg("delay").alias("temp"))
    station_of = spark.range(100).select(F.col("id").cast("int").alias("stop"), (F.col("id") % 10).cast("int").alias("station"))
    return features.with_weather(o, station_of, weather, ["temp"]).select("event_id", R4("temp").alias("temp"), R4("temp_bus").alias("temp_bus"))


@query("""WITH f AS (SELECT n_nationkey AS c, DATE '1996-01-01' + CAST(n_nationkey AS INTEGER) AS day, n_nationkey % 2 AS holiday FROM nation)
  SELECT o_orderkey, coalesce(f.holiday, 0)::INTEGER AS holiday FROM orders LEFT JOIN f ON f.c = o_custkey % 25 AND f.day = CAST(o_orderdate AS DATE)""")
def j12_calendar_broadcast(spark, d):
    f = read(spark, d, "nation").select(F.col("n_nationkey").alias("c"), F.date_add(F.lit("1996-01-01").cast("date"), F.col("n_nationkey")).alias("day"), (F.col("n_nationkey") % 2).alias("holiday"))
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    j = o.join(f, (F.col("o_custkey") % 25 == F.col("c")) & (F.to_date("o_orderdate") == F.col("day")), "left")
    return j.select("o_orderkey", F.coalesce("holiday", F.lit(0)).cast("int").alias("holiday"))


_HIST = list(features.KEY_SETS)


def _hist_sql() -> str:
    parts, joins, cols = [], [], []
    for i, keys in enumerate(_HIST):
        k = ", ".join(keys)
        parts.append(f"h{i} AS (SELECT {k}, count(*) AS n, avg(delay) AS m, quantile_disc(delay, 0.5) AS p50, quantile_disc(delay, 0.95) AS p95 FROM train GROUP BY {k})")
        joins.append(f"LEFT JOIN h{i} ON " + " AND ".join(f"h{i}.{c} = e.{c}" for c in keys))
        name = "_".join(keys)
        cols.append(f"coalesce(h{i}.n, 0) AS h_{name}_n, round(coalesce(h{i}.m, g.m) + 1e-9, 4) AS h_{name}_mean, coalesce(h{i}.p50, g.p50) AS h_{name}_p50, coalesce(h{i}.p95, g.p95) AS h_{name}_p95")
    return f"""WITH {OBSERVATIONS}, train AS (SELECT * FROM obs WHERE operating_day < DATE '2024-01-21'), g AS (SELECT avg(delay) AS m, quantile_disc(delay, 0.5) AS p50, quantile_disc(delay, 0.95) AS p95 FROM train), {', '.join(parts)}
  SELECT e.event_id, {', '.join(cols)} FROM obs e CROSS JOIN g {' '.join(joins)} WHERE e.operating_day >= DATE '2024-01-21'"""


@query(_hist_sql())
def j13_hist_features(spark, d):
    o = observations(spark, d)
    out = features.with_history(o.filter("operating_day >= '2024-01-21'"), o.filter("operating_day < '2024-01-21'"), "delay", _HIST, (0.5, 0.95))
    names = ["h_" + "_".join(k) for k in _HIST]
    return out.select("event_id", *[c for n in names for c in (F.col(f"{n}_n"), R4(f"{n}_mean").alias(f"{n}_mean"), F.col(f"{n}_p50"), F.col(f"{n}_p95"))])


_SEQ = f"{OBSERVATIONS}, q AS (SELECT *, row_number() OVER (PARTITION BY operating_day, trip_id ORDER BY secs, event_id) AS seq FROM obs), leg AS (SELECT b.operating_day, b.trip_id AS trip, b.bpuic AS f, a.bpuic AS t, b.secs AS dep, a.secs AS arr FROM q b JOIN q a ON a.operating_day = b.operating_day AND a.trip_id = b.trip_id AND b.seq < a.seq)"


@query(f"WITH {_SEQ} SELECT operating_day, trip, f, t, dep, arr FROM leg", days=("operating_day",))
def j14_direct_pairs(spark, d):
    return journeys.legs(journeys.sequenced(observations(spark, d)), "leg1").select("operating_day", F.col("leg1_trip").alias("trip"), F.col("leg1_from").alias("f"), F.col("leg1_to").alias("t"), F.col("leg1_dep").alias("dep"), F.col("leg1_arr").alias("arr"))


_ONE = "SELECT x.operating_day, x.trip AS t1, y.trip AS t2, x.f AS origin, y.t AS dest, x.t AS via, y.dep - x.arr AS wait FROM leg x JOIN leg y ON x.operating_day = y.operating_day AND x.t = y.f AND x.trip <> y.trip AND y.dep - x.arr BETWEEN 120 AND 21600 AND x.f <> y.t"


@query(f"WITH {_SEQ} {_ONE}", days=("operating_day",))
def j15_transfer_interval(spark, d):
    t = journeys.transfers(journeys.sequenced(observations(spark, d)), 1, high=21_600)
    return t.select("operating_day", F.col("leg1_trip").alias("t1"), F.col("leg2_trip").alias("t2"), F.col("leg1_from").alias("origin"), F.col("leg2_to").alias("dest"), F.col("leg1_to").alias("via"), F.col("xfer1_secs").alias("wait"))


def _days_as_text(o):
    """Days in the form the result has, worked out once an event rather than once a journey."""
    return o.withColumn("operating_day", F.col("operating_day").cast("string"))


_TWO = """SELECT x.operating_day, x.trip AS t1, y.trip AS t2, z.trip AS t3, x.f AS origin, z.t AS dest, y.dep - x.arr AS w1, z.dep - y.arr AS w2 FROM leg x JOIN leg y ON x.operating_day = y.operating_day AND x.t = y.f AND x.trip <> y.trip AND y.dep - x.arr BETWEEN 120 AND 21600
  JOIN leg z ON z.operating_day = y.operating_day AND y.t = z.f AND z.trip <> y.trip AND z.trip <> x.trip AND z.dep - y.arr BETWEEN 120 AND 21600 WHERE x.f <> z.t"""


@query(f"WITH {_SEQ} {_TWO}", days=("operating_day",))
def j16_two_transfers(spark, d):
    t = journeys.transfers(journeys.sequenced(_days_as_text(observations(spark, d))), 2, high=21_600, details=False)
    return t.select("operating_day", F.col("leg1_trip").alias("t1"), F.col("leg2_trip").alias("t2"), F.col("leg3_trip").alias("t3"), F.col("leg1_from").alias("origin"), F.col("leg3_to").alias("dest"), F.col("xfer1_secs").alias("w1"), F.col("xfer2_secs").alias("w2"))


@query(f"""WITH {_SEQ}, l2 AS (SELECT * FROM leg) SELECT a.operating_day, a.trip AS t1, b.trip AS t2, c.trip AS t3, e.trip AS t4, a.f AS origin, e.t AS dest FROM leg a JOIN leg b ON a.operating_day = b.operating_day AND a.t = b.f AND b.dep - a.arr BETWEEN 120 AND 43200
  JOIN leg c ON c.operating_day = b.operating_day AND b.t = c.f AND c.dep - b.arr BETWEEN 120 AND 43200 JOIN leg e ON e.operating_day = c.operating_day AND c.t = e.f AND e.dep - c.arr BETWEEN 120 AND 43200
  WHERE a.trip <> b.trip AND a.trip <> c.trip AND a.trip <> e.trip AND b.trip <> c.trip AND b.trip <> e.trip AND c.trip <> e.trip AND a.f <> e.t""", days=("operating_day",))
def j17_three_transfers(spark, d):
    t = journeys.transfers(journeys.sequenced(_days_as_text(observations(spark, d))), 3, high=43_200, details=False)
    return t.select("operating_day", *[F.col(f"leg{k}_trip").alias(f"t{k}") for k in range(1, 5)], F.col("leg1_from").alias("origin"), F.col("leg4_to").alias("dest"))


@query(f"""WITH {_SEQ}, hub AS (SELECT bpuic FROM obs GROUP BY 1 ORDER BY count(*) DESC, bpuic LIMIT 20) SELECT operating_day, trip, f, t, arr - dep AS took FROM leg WHERE f IN (SELECT * FROM hub) AND t IN (SELECT * FROM hub) AND arr - dep BETWEEN 300 AND 18000""", days=("operating_day",))
def j18_hub_legs(spark, d):
    o = observations(spark, d)
    hub = o.groupBy("bpuic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bpuic").limit(20).select("bpuic")
    seq = journeys.sequenced(o)
    legs = journeys.legs(seq, "l").join(hub.withColumnRenamed("bpuic", "l_from"), "l_from", "left_semi").join(hub.withColumnRenamed("bpuic", "l_to"), "l_to", "left_semi")
    took = F.col("l_arr") - F.col("l_dep")
    return legs.filter(took.between(300, 18_000)).select("operating_day", F.col("l_trip").alias("trip"), F.col("l_from").alias("f"), F.col("l_to").alias("t"), took.alias("took"))


@query("SELECT o_orderkey, b AS deadline_buffer_sec FROM orders CROSS JOIN (VALUES (0), (600), (1800)) t(b)")
def j19_deadline_expand(spark, d):
    return journeys.with_deadlines(read(spark, d, "orders", "o_orderkey"))


@query("WITH w AS (SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS pub FROM events) SELECT pub, count(*) AS n, count(DISTINCT user_id) AS users FROM events JOIN w ON CAST(ts AS DATE) BETWEEN pub AND pub + 6 GROUP BY 1", days=("pub",))
def j20_week_range(spark, d):
    """A range join as an equi-join: each version's week becomes its seven days."""
    o = observations(spark, d)
    weeks = o.select(F.to_date(F.date_trunc("week", "ts")).alias("pub")).distinct().withColumn("operating_day", F.explode(F.sequence("pub", F.date_add("pub", 6))))
    return o.join(weeks, "operating_day").groupBy("pub").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"WITH {OBSERVATIONS} SELECT operating_day, bpuic FROM (SELECT DISTINCT operating_day, bpuic FROM obs WHERE transport = 'view') JOIN (SELECT DISTINCT operating_day, bpuic FROM obs WHERE transport = 'click') USING (operating_day, bpuic)", days=("operating_day",))
def j21_intersect_join(spark, d):
    o = observations(spark, d)
    part = lambda t: o.filter(F.col("transport") == t).select("operating_day", "bpuic").distinct()
    return part("view").join(part("click"), ["operating_day", "bpuic"], "left_semi")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def j22_unobserved_anti(spark, d):
    seen = read(spark, d, "lineitem", "l_partkey", "l_quantity").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, d, "part", "p_partkey").join(seen, "p_partkey", "left_anti")


@query(f"""WITH {STOP_TIMES}, pl AS (SELECT trip_id, stop, trip_id % 3 AS agency, nullif(stop_sequence, 1) AS arr, arr_secs AS dep FROM st), ob AS (SELECT trip_id AS obs_trip, DATE '2024-01-01' + CAST(trip_id % 5 AS INTEGER) AS day, stop, trip_id % 3 AS agency, nullif(stop_sequence, 1) AS arr, arr_secs AS dep FROM st),
  m AS (SELECT pl.trip_id, ob.day, ob.obs_trip, count(DISTINCT pl.stop) AS met FROM pl JOIN ob ON pl.stop = ob.stop AND pl.agency = ob.agency AND pl.arr IS NOT DISTINCT FROM ob.arr AND pl.dep IS NOT DISTINCT FROM ob.dep GROUP BY 1, 2, 3)
  SELECT trip_id, day, obs_trip FROM m JOIN (SELECT trip_id, count(DISTINCT stop) AS size FROM pl GROUP BY 1) USING (trip_id) WHERE met = size""", days=("day",))
def j23_null_safe_align(spark, d):
    st = stop_times(spark, d).select("trip_id", "stop", (F.col("trip_id") % 3).alias("agency"), F.nullif(F.col("stop_sequence"), F.lit(1)).alias("arr"), F.col("arr_secs").alias("dep"))
    observed = st.select(F.col("trip_id").alias("obs_trip"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("trip_id") % 5).cast("int")).alias("day"), "stop", "agency", "arr", "dep")
    return features.align_trips(st, observed)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def j24_valid_pairs(spark, d):
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    valid = li.groupBy("l_partkey", "l_suppkey").count().filter("count > 1")
    return li.join(valid, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
  SELECT coalesce(a.day, b.day) AS day, coalesce(n_f, 0) AS n_f, coalesce(n_o, 0) AS n_o FROM a FULL JOIN b ON a.day = b.day""", days=("day",))
def j25_full_outer(spark, d):
    o = read(spark, d, "orders", "o_orderdate", "o_orderstatus").withColumn("day", F.to_date("o_orderdate"))
    part = lambda s, n: o.filter(F.col("o_orderstatus") == s).groupBy("day").agg(F.count("*").alias(n))
    return part("F", "n_f").join(part("O", "n_o"), "day", "full").na.fill(0)


@query(f"WITH {OBSERVATIONS}, {STOPS}, {_AREAS}, m AS (SELECT stop, area FROM stops, areas WHERE lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1) SELECT area, transport, count(*) AS n, round(avg(delay) + 1e-9, 4) AS mean FROM obs JOIN m ON stop = bpuic GROUP BY 1, 2")
def j26_district_explode(spark, d):
    points = stops(spark, d).select("stop", F.col("lon").alias("x"), F.col("lat").alias("y"))
    m = geo.assign_areas(points, _areas(spark), "stop", "area").withColumnRenamed("stop", "bpuic")
    return observations(spark, d).join(m, "bpuic").groupBy("area", "transport").agg(F.count("*").alias("n"), R4(F.avg("delay")).alias("mean"))


@query(f"""WITH {OBSERVATIONS}, t AS (SELECT * FROM obs WHERE operating_day < DATE '2024-01-11'), g AS (SELECT bpuic, transport, hour, quantile_disc(delay, 0.9) AS p FROM t GROUP BY 1, 2, 3)
  SELECT event_id, coalesce(p, (SELECT quantile_disc(delay, 0.9) FROM t)) AS predicted FROM obs LEFT JOIN g USING (bpuic, transport, hour) WHERE operating_day >= DATE '2024-01-11'""")
def j27_group_lookup(spark, d):
    o = observations(spark, d)
    return evaluation.group_baseline(o.filter("operating_day >= '2024-01-11'"), o.filter("operating_day < '2024-01-11'"), ["bpuic", "transport", "hour"], "delay", 0.9).select("event_id", "predicted")


@query(f"WITH {STOP_TIMES} SELECT a.trip_id, a.stop AS dep_stop, b.stop AS arr_stop, a.arr_secs AS dep_secs, b.arr_secs AS arr_secs, a.stop_sequence AS dep_seq FROM st a JOIN st b ON a.trip_id = b.trip_id AND b.stop_sequence = a.stop_sequence + 1")
def j28_sequence_join(spark, d):
    return timetable.connections_by_join(stop_times(spark, d))


@query(f"WITH {STOPS} SELECT a.stop AS a, b.stop AS b, round(1000 * {_KM}, 3) AS metres FROM stops a, stops b WHERE a.stop <> b.stop AND 1000 * {_KM} <= 9000")
def j29_walking_pairs(spark, d):
    return geo.pairs_within(stops(spark, d), "stop", 9000.0).withColumn("metres", F.round("metres", 3))


@query("""SELECT p_partkey, p_name, s_name, n FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) JOIN part ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey > 12) ON s_suppkey = l_suppkey WHERE p_size < 5""")
def j30_enrichment(spark, d):
    missing = read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_returnflag").filter("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    p, s = read(spark, d, "part", "p_partkey", "p_name", "p_size").filter("p_size < 5"), read(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey").filter("s_nationkey > 12")
    return missing.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("p_partkey", "p_name", "s_name", "n")


@query("SELECT s_suppkey, n_name AS operator_name FROM supplier LEFT JOIN (SELECT DISTINCT n_nationkey, n_name FROM nation WHERE n_regionkey < 3) ON n_nationkey = s_nationkey")
def j31_operator_name(spark, d):
    names = read(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("operator_name")).distinct()
    return read(spark, d, "supplier", "s_suppkey", "s_nationkey").join(names, "s_nationkey", "left").select("s_suppkey", "operator_name")


@query("SELECT l_orderkey, l_partkey, l_suppkey, lpad(CAST(l_quantity AS INTEGER)::VARCHAR, 2, '0') || ':00:00' AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE lpad(CAST(l_quantity AS INTEGER)::VARCHAR, 2, '0') || ':00:00' >= '46:00:00' ORDER BY t DESC, l_orderkey, l_partkey, l_suppkey LIMIT 50")
def j33_extreme_trips(spark, d):
    li = read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity").withColumn("t", clock.clock_text(F.col("l_quantity") * 3600))
    o = read(spark, d, "orders", "o_orderkey")
    return li.filter("t >= '46:00:00'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).orderBy(F.desc("t"), "l_orderkey", "l_partkey", "l_suppkey").limit(50).select("l_orderkey", "l_partkey", "l_suppkey", "t")


# --- aggregations -----------------------------------------------------------------------------------


@query("""SELECT stop, max(s_name) AS name, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM (SELECT s_suppkey // 4 AS stop, s_name, 46 + s_suppkey / 100.0::DOUBLE AS lat, 6 + s_nationkey / 10.0::DOUBLE AS lon FROM supplier WHERE s_suppkey % 10 <> 0) GROUP BY 1""")
def a1_stop_merge(spark, d):
    s = read(spark, d, "supplier")
    head = F.when(F.col("s_suppkey") % 10 == 0, F.lit("Parent")).otherwise(F.floor(F.col("s_suppkey") / 4).cast("string"))
    rows = s.select(F.concat_ws(":", head, F.lit("0"), (F.col("s_suppkey") % 4).cast("string")).alias("stop_id"), F.col("s_name").alias("stop_name"), (46 + F.col("s_suppkey") / 100.0).alias("stop_lat"), (6 + F.col("s_nationkey") / 10.0).alias("stop_lon"))
    return timetable.build_stops(rows).withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6)).withColumn("stop", F.col("stop").cast("long"))


@query("SELECT n_regionkey, min(nullif(n_name, 'NATION_0')) AS first_name FROM nation GROUP BY 1")
def a2_first_known(spark, d):
    return read(spark, d, "nation").groupBy("n_regionkey").agg(F.min(F.nullif(F.col("n_name"), F.lit("NATION_0"))).alias("first_name"))


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def a3_newest_version(spark, d):
    return tables.newest(read(spark, d, "orders", "o_orderkey", "o_orderdate").withColumn("v", F.year("o_orderdate")), "v").select("o_orderkey")


_P = ", ".join(f"quantile_disc(delay, {q}) AS h_p{round(q * 100):02d}" for q in (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95))


@query(f"WITH {OBSERVATIONS} SELECT transport, hour, count(*) AS h_n, round(avg(delay) + 1e-9, 4) AS h_mean, {_P} FROM obs GROUP BY 1, 2")
def a4_group_percentiles(spark, d):
    return features.history(observations(spark, d), ["transport", "hour"], "delay", "h").withColumn("h_mean", R4("h_mean"))


@query(f"WITH {OBSERVATIONS} SELECT round(avg(delay) + 1e-9, 4) AS all_mean, {_P.replace('h_p', 'all_p')} FROM obs")
def a5_global_fallback(spark, d):
    return features.overall(observations(spark, d), "delay").withColumn("all_mean", R4("all_mean"))


@query(f"""WITH {OBSERVATIONS} SELECT grouping_id(transport, hour, dow) AS g, transport, hour, dow, count(*) AS n, round(avg(delay) + 1e-9, 4) AS mean FROM obs GROUP BY GROUPING SETS ((transport), (hour), (transport, hour), (dow), ())""")
def a6_grouping_sets(spark, d):
    """Several key sets' aggregates in one pass, as grouping sets."""
    observations(spark, d).createOrReplaceTempView("slackline_obs")
    return spark.sql("SELECT grouping_id(transport, hour, dow) AS g, transport, hour, dow, count(*) AS n, round(avg(delay) + 1e-9, 4) AS mean FROM slackline_obs GROUP BY transport, hour, dow GROUPING SETS ((transport), (hour), (transport, hour), (dow), ())")


@query(f"WITH {OBSERVATIONS} SELECT user_id % 10 AS station, month, round(avg(delay) + 1e-9, 4) AS temp FROM obs GROUP BY 1, 2")
def a7_climatology(spark, d):
    w = observations(spark, d).select((F.col("user_id") % 10).alias("station"), F.date_trunc("hour", "ts").alias("hour_start"), F.col("delay").alias("temp"))
    return features.climatology(w, ["temp"]).withColumn("temp", R4("temp"))


@query(f"WITH {OBSERVATIONS} SELECT bpuic, transport, hour, dow, round(coalesce(avg(delay), 0) + 1e-9, 4) AS delay, round(coalesce(avg(nullif(user_id, 1)), 0) + 1e-9, 4) AS users FROM obs GROUP BY 1, 2, 3, 4")
def a8_combo_means(spark, d):
    o = observations(spark, d).withColumn("users", F.nullif(F.col("user_id"), F.lit(1)))
    return o.groupBy("bpuic", "transport", "hour", "dow").agg(R4(F.coalesce(F.avg("delay"), F.lit(0.0))).alias("delay"), R4(F.coalesce(F.avg("users"), F.lit(0.0))).alias("users"))


@query("SELECT n_regionkey AS region, l_returnflag, l_linestatus, round(avg(l_quantity) + 1e-9, 4) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3")
def a9_district_means(spark, d):
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey").join(read(spark, d, "nation", "n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    li = read(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("n_regionkey").alias("region"), "l_returnflag", "l_linestatus").agg(R4(F.avg("l_quantity")).alias("quantity"))


@query(f"WITH {OBSERVATIONS} SELECT round(avg(CASE WHEN delay >= 40 THEN 0.5 * (delay - 40) ELSE 0.5 * (40 - delay) END) + 1e-9, 4) AS pinball_50, round(avg(CASE WHEN delay >= 110 THEN 0.9 * (delay - 110) ELSE (1 - 0.9) * (110 - delay) END) + 1e-9, 4) AS pinball_90 FROM obs")
def a10_pinball_global(spark, d):
    o = observations(spark, d).withColumn("p50", F.lit(40.0)).withColumn("p90", F.lit(110.0))
    return evaluation.pinball_losses(o, "delay", {0.5: "p50", 0.9: "p90"}).select(R4("pinball_50").alias("pinball_50"), R4("pinball_90").alias("pinball_90"))


@query(f"""WITH {OBSERVATIONS}, t AS (SELECT * FROM obs WHERE operating_day < DATE '2024-01-16'), g AS (SELECT bpuic, quantile_disc(delay, 0.8) AS p FROM t GROUP BY 1), v AS (SELECT delay, coalesce(p, (SELECT quantile_disc(delay, 0.8) FROM t)) AS p FROM obs LEFT JOIN g USING (bpuic) WHERE operating_day >= DATE '2024-01-16')
  SELECT round(avg(CASE WHEN delay >= p THEN 0.8 * (delay - p) ELSE (1 - 0.8) * (p - delay) END) + 1e-9, 4) AS pinball_80 FROM v""")
def a11_baseline_group(spark, d):
    o = observations(spark, d)
    scored = evaluation.group_baseline(o.filter("operating_day >= '2024-01-16'"), o.filter("operating_day < '2024-01-16'"), ["bpuic"], "delay", 0.8)
    return evaluation.pinball_losses(scored, "delay", {0.8: "predicted"}).select(R4("pinball_80").alias("pinball_80"))


@query("""SELECT round(sqrt(avg((50 - value) * (50 - value))) + 1e-9, 4) AS rmse, round(avg(abs(50 - value)) + 1e-9, 4) AS mae, round(1 - sum((50 - value) * (50 - value)) / (var_pop(value) * count(*)), 6) AS r2, round(avg(50 - value) + 1e-9, 4) AS bias,
  round(quantile_disc(abs(50 - value), 0.9) + 1e-9, 4) AS p90_abs, round(quantile_disc(abs(50 - value), 0.95) + 1e-9, 4) AS p95_abs, round(avg(CASE WHEN 50 - value < 0 THEN 1.0::DOUBLE ELSE 0 END) + 1e-9, 4) AS under_rate FROM events""")
def a12_regression_metrics(spark, d):
    m = evaluation.regression_metrics(read(spark, d, "events", "value").withColumn("p", F.lit(50.0)), "value", "p")
    return m.select(*[(F.round(c, 6) if c == "r2" else R4(c)).alias(c) for c in m.columns])


@query(None)
def a14_approx_distinct(spark, d):
    return read(spark, d, "lineitem", "l_returnflag", "l_orderkey", "l_partkey").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("trips"), F.approx_count_distinct("l_partkey").alias("parts"))


@query(f"WITH {OBSERVATIONS} SELECT count(*) AS n, count(DISTINCT operating_day) AS days, count(DISTINCT trip_id) AS trips, count(DISTINCT bpuic) AS stops, count(DISTINCT transport) AS modes, count(DISTINCT user_id) AS users, count(DISTINCT hour) AS hours FROM obs")
def a15_coverage(spark, d):
    return observations(spark, d).agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(n) for c, n in (("operating_day", "days"), ("trip_id", "trips"), ("bpuic", "stops"), ("transport", "modes"), ("user_id", "users"), ("hour", "hours"))])


@query("SELECT event_type, count(value) AS n, round(avg(value) + 1e-9, 4) AS mean, round(stddev(value) + 1e-9, 4) AS sd, min(value) AS least, max(value) AS most, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def a16_summary(spark, d):
    return evaluation.summary(read(spark, d, "events", "event_type", "value"), "value", ["event_type"]).withColumn("mean", R4("mean")).withColumn("sd", R4("sd"))


@query("SELECT event_type, count(*) AS n, round(100.0::DOUBLE * sum(CASE WHEN value <= 3 THEN 1 ELSE 0 END) / count(*) + 1e-9, 4) AS on_time_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE value > 120) / count(*) + 1e-9, 4) AS extreme_pct FROM events GROUP BY 1")
def a17_quality_pct(spark, d):
    pct = lambda c: R4(100.0 * F.count_if(c) / F.count("*"))
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), pct(F.col("value") <= 3).alias("on_time_pct"), pct(F.col("value") > 120).alias("extreme_pct"))


@query("SELECT count(*) FILTER (WHERE l_quantity >= 24) AS over_day, count(*) FILTER (WHERE l_quantity < 24) AS within_day, max(l_quantity) AS most FROM lineitem")
def a18_filtered_count(spark, d):
    return read(spark, d, "lineitem", "l_quantity").agg(F.count_if(F.col("l_quantity") >= 24).alias("over_day"), F.count_if(F.col("l_quantity") < 24).alias("within_day"), F.max("l_quantity").alias("most"))


@query("""WITH x AS (SELECT p_type, nullif(p_size % 3, 0) AS a, nullif(p_size % 4, 0) AS b FROM part) SELECT p_type, count(*) FILTER (WHERE a IS NULL AND b IS NULL) AS both_null, count(*) FILTER (WHERE a IS NULL AND b IS NOT NULL) AS only_a,
  count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL) AS only_b, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS none_null FROM x GROUP BY 1""")
def a19_null_crosstab(spark, d):
    x = read(spark, d, "part").select("p_type", F.nullif(F.col("p_size") % 3, F.lit(0)).alias("a"), F.nullif(F.col("p_size") % 4, F.lit(0)).alias("b"))
    a, b = F.col("a").isNull(), F.col("b").isNull()
    return x.groupBy("p_type").agg(F.count_if(a & b).alias("both_null"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("none_null"))


@query("""WITH x AS (SELECT p_partkey, nullif(p_size % 3, 0) AS a, nullif(p_brand, 'Brand#3') AS b FROM part) SELECT 'p_partkey' AS "column", count(*) - count(p_partkey) AS nulls, count(*) AS rows FROM x
  UNION ALL SELECT 'a', count(*) - count(a), count(*) FROM x UNION ALL SELECT 'b', count(*) - count(b), count(*) FROM x""")
def a20_null_profile(spark, d):
    return tables.null_profile(read(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size") % 3, F.lit(0)).alias("a"), F.nullif(F.col("p_brand"), F.lit("Brand#3")).alias("b")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a21_frequency(spark, d):
    return read(spark, d, "lineitem", "l_returnflag", "l_linestatus").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query(f"WITH {OBSERVATIONS} SELECT month, transport, dow, quantile_disc(delay, 0.9) AS p90 FROM obs GROUP BY 1, 2, 3 HAVING quantile_disc(delay, 0.9) > 110")
def a22_p90_having(spark, d):
    p = F.percentile_approx("delay", F.lit(0.9), F.lit(1_000_000))
    return observations(spark, d).groupBy("month", "transport", "dow").agg(p.alias("p90")).filter("p90 > 110")


@query(f"WITH {OBSERVATIONS} SELECT month, bpuic, quantile_disc(delay, 0.9) AS p90 FROM obs GROUP BY 1, 2 HAVING quantile_disc(delay, 0.9) > 100")
def a23_p90_stop(spark, d):
    return observations(spark, d).groupBy("month", "bpuic").agg(F.percentile_approx("delay", F.lit(0.9), F.lit(1_000_000)).alias("p90")).filter("p90 > 100")


@query(f"WITH {OBSERVATIONS} SELECT date_trunc('hour', ts)::TIMESTAMP AS hour_start, bpuic, quantile_disc(delay, 0.9) AS p90 FROM obs GROUP BY 1, 2")
def a24_hourly_p90(spark, d):
    return observations(spark, d).groupBy(F.date_trunc("hour", "ts").alias("hour_start"), "bpuic").agg(F.percentile_approx("delay", F.lit(0.9), F.lit(1_000_000)).alias("p90"))


@query(f"WITH {OBSERVATIONS} SELECT hour, count(*) AS n, round(avg(delay) + 1e-9, 4) AS mean, quantile_disc(delay, 0.5) AS median, quantile_disc(delay, 0.9) AS p90 FROM obs GROUP BY 1")
def a25_hour_profile(spark, d):
    p = F.percentile_approx("delay", [0.5, 0.9], 1_000_000)
    g = observations(spark, d).groupBy("hour").agg(F.count("*").alias("n"), R4(F.avg("delay")).alias("mean"), p.alias("p"))
    return g.select("hour", "n", "mean", F.get("p", F.lit(0)).alias("median"), F.get("p", F.lit(1)).alias("p90"))


@query("SELECT o_orderstatus, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE))::INTEGER AS span FROM orders GROUP BY 1", days=("first", "last",))
def a26_span(spark, d):
    g = read(spark, d, "orders").groupBy("o_orderstatus").agg(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    return g.withColumn("span", F.datediff("last", "first"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS trips, sum(CASE WHEN l_linenumber = 3 OR l_discount = 0.03 THEN 1 ELSE 0 END)::BIGINT AS on_demand FROM lineitem GROUP BY 1")
def a27_on_demand(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("trips"), F.count_if((F.col("l_linenumber") == 3) | (F.col("l_discount") == 0.03)).alias("on_demand"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\" FROM orders GROUP BY 1", days=("day",))
def a28_pivot(spark, d):
    return read(spark, d, "orders", "o_orderdate", "o_orderstatus").groupBy(F.to_date("o_orderdate").alias("day")).pivot("o_orderstatus", ["F", "O"]).count().na.fill(0)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a29_duplicates(spark, d):
    return read(spark, d, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT nullif(p_size % 7, 0) AS k, count(*) AS n FROM part GROUP BY 1 HAVING nullif(p_size % 7, 0) IS NOT NULL")
def a30_having_not_null(spark, d):
    return read(spark, d, "part").groupBy(F.nullif(F.col("p_size") % 7, F.lit(0)).alias("k")).agg(F.count("*").alias("n")).filter("k is not null")


@query(f"WITH {OBSERVATIONS} SELECT strftime(operating_day, '%m/%Y') AS month, transport, CASE WHEN least(greatest(delay, 0), 120) = 0 THEN 'NO DELAY' WHEN least(greatest(delay, 0), 120) <= 3 THEN 'NORMAL DELAY' ELSE 'EXCESSIVE_DELAY' END AS severity, count(*) AS n FROM obs GROUP BY 1, 2, 3")
def a31_severity_dist(spark, d):
    return observations(spark, d).groupBy(F.date_format("operating_day", "MM/yyyy").alias("month"), "transport", C.severity(F.col("delay")).alias("severity")).agg(F.count("*").alias("n"))


@query(f"WITH {OBSERVATIONS} SELECT user_id, count(*) AS n FROM obs GROUP BY 1 ORDER BY n DESC, user_id LIMIT 15")
def a32_top_operators(spark, d):
    return observations(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(15)


_REPLAY = """SELECT event_id, event_type AS stratum, CASE hour(ts) % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 ELSE 0.9 END AS confidence_q, CASE WHEN event_id % 11 <> 0 THEN value < 60 END AS std_success, CASE WHEN event_id % 13 <> 0 THEN value < 90 END AS rob_success, value AS std_ms, value / 2 AS rob_ms, event_id % 4 = 0 AS routes_identical, (event_id % 5) / 5.0::DOUBLE AS overlap FROM events"""
_RMEANS = "count(*) AS n, round(avg(std_success::INT) + 1e-9, 4) AS std_success, round(avg(rob_success::INT) + 1e-9, 4) AS rob_success, round(avg(std_ms) + 1e-9, 4) AS std_ms, round(avg(rob_ms) + 1e-9, 4) AS rob_ms, round(avg(routes_identical::INT) + 1e-9, 4) AS routes_identical, round(avg(overlap) + 1e-9, 4) AS overlap"


def _replays(spark, d):
    h = F.hour("ts") % 3
    id_ = F.col("event_id")
    return read(spark, d, "events").select(
        "event_id", F.col("event_type").alias("stratum"), F.when(h == 0, 0.5).when(h == 1, 0.8).otherwise(0.9).alias("confidence_q"), F.when(id_ % 11 != 0, F.col("value") < 60).alias("std_success"), F.when(id_ % 13 != 0, F.col("value") < 90).alias("rob_success"),
        F.col("value").alias("std_ms"), (F.col("value") / 2).alias("rob_ms"), (id_ % 4 == 0).alias("routes_identical"), ((id_ % 5) / 5.0).alias("overlap"),
    )


def _rounded(df, *keys):
    return df.select(*keys, "n", *[R4(c).alias(c) for c in ("std_success", "rob_success", "std_ms", "rob_ms", "routes_identical", "overlap")])


@query(f"SELECT confidence_q::DOUBLE AS confidence_q, {_RMEANS} FROM ({_REPLAY}) GROUP BY 1")
def a33_replay_summary(spark, d):
    return _rounded(evaluation.replay_summary(_replays(spark, d), ["confidence_q"]), "confidence_q")


@query(f"SELECT stratum, confidence_q::DOUBLE AS confidence_q, {_RMEANS} FROM ({_REPLAY}) GROUP BY 1, 2")
def a34_replay_strata(spark, d):
    return _rounded(evaluation.replay_summary(_replays(spark, d), ["stratum", "confidence_q"]), "stratum", "confidence_q")


_CAL = " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round(avg(CASE WHEN {p} >= value THEN 1.0::DOUBLE ELSE 0 END) + 1e-9, 4) AS success, round({p} / 60.0::DOUBLE + 1e-9, 4) AS mean_buffer_min, round(avg(CASE WHEN {p} >= value THEN 1.0::DOUBLE ELSE 0 END) - {q} + 1e-9, 4) AS gap FROM events" for q, p in ((0.5, 35), (0.8, 80), (0.9, 113)))


@query(_CAL)
def a35_calibration(spark, d):
    e = read(spark, d, "events", "value").withColumns({"p50": F.lit(35.0), "p80": F.lit(80.0), "p90": F.lit(113.0)})
    c = evaluation.calibration(e, "value", {0.5: "p50", 0.8: "p80", 0.9: "p90"})
    return c.select("q", *[R4(n).alias(n) for n in ("success", "mean_buffer_min", "gap")])


@query("SELECT event_type, count(value) AS n, round(avg(value) + 1e-9, 4) AS mean, min(value) AS least, max(value) AS most, round(CASE WHEN count(value) < 20 THEN max(value) ELSE quantile_cont(value, 0.95) END + 1e-9, 4) AS p95, round(sum(value) + 1e-9, 4) AS total FROM events GROUP BY 1")
def a37_latency(spark, d):
    s = evaluation.latency_stats(read(spark, d, "events", "event_type", "value"), "value", ["event_type"])
    return s.select("event_type", "n", R4("mean").alias("mean"), "least", "most", R4("p95").alias("p95"), R4("total").alias("total"))


@query(f"""WITH {OBSERVATIONS}, b AS (SELECT bpuic, hour, quantile_disc(delay, 0.5) AS p50, quantile_disc(delay, 0.9) AS p90 FROM obs GROUP BY 1, 2) SELECT round(count(*) FILTER (WHERE p50 < 30)::DOUBLE / count(*) + 1e-9, 4) AS share_0_30, round(count(*) FILTER (WHERE p50 >= 30 AND p50 < 60)::DOUBLE / count(*) + 1e-9, 4) AS share_30_60,
  round(count(*) FILTER (WHERE p50 >= 60 AND p50 < 120)::DOUBLE / count(*) + 1e-9, 4) AS share_60_120, round(count(*) FILTER (WHERE p50 >= 120 AND p50 < 300)::DOUBLE / count(*) + 1e-9, 4) AS share_120_300, round(count(*) FILTER (WHERE p50 >= 300)::DOUBLE / count(*) + 1e-9, 4) AS share_300_up, round(median(p50) + 1e-9, 4) AS median_p50, round(avg(p90) + 1e-9, 4) AS mean_p90 FROM b""")
def a38_bucket_summary(spark, d):
    b = observations(spark, d).groupBy("bpuic", "hour").agg(F.percentile_approx("delay", [0.5, 0.9], 1_000_000).alias("p")).select(F.get("p", F.lit(0)).alias("p50"), F.get("p", F.lit(1)).alias("p90"))
    s = evaluation.bucket_summary(b, "p50", "p90")
    return s.select(*[R4(c).alias(c) for c in s.columns])


_CONN = f"{STOP_TIMES}, nx AS (SELECT *, lead(stop) OVER w AS arr_stop, lead(arr_secs) OVER w AS nxt FROM st WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)), conn AS (SELECT trip_id, stop AS dep_stop, arr_stop, arr_secs AS dep_secs, nxt AS arr_secs, stop_sequence AS dep_seq FROM nx WHERE arr_stop IS NOT NULL AND nxt >= arr_secs AND stop <> arr_stop AND NOT (nxt - arr_secs >= 86400 AND nxt - arr_secs - 86400 <= 21600))"


@query(f"WITH {_CONN}, u AS (SELECT stop, count(*) AS uses FROM (SELECT dep_stop AS stop FROM conn UNION ALL SELECT arr_stop FROM conn) GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY uses DESC, stop) AS place FROM u) SELECT stop, uses, place::INTEGER AS place, CASE WHEN place <= 30 THEN 'hub' WHEN place <= 150 THEN 'major' ELSE 'minor' END AS tier FROM r")
def a39_busyness(spark, d):
    return timetable.busyness(timetable.build_connections(stop_times(spark, d)))


@query(f"WITH {STOPS}, p AS (SELECT a.stop AS a FROM stops a, stops b WHERE a.stop <> b.stop AND 1000 * {_KM} <= 9000) SELECT a AS stop, count(*) AS neighbours FROM p GROUP BY 1")
def a40_walk_degree(spark, d):
    return timetable.walk_degree(geo.pairs_within(stops(spark, d), "stop", 9000.0))


@query("SELECT event_type AS model, round(avg(value), 2) AS rmse, count(*) AS folds FROM events GROUP BY 1")
def a41_cv_summary(spark, d):
    return read(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg("value"), 2).alias("rmse"), F.count("*").alias("folds"))


@query(f"""WITH {OBSERVATIONS}, g AS (SELECT bpuic, transport, hour, quantile_disc(delay, 0.5) AS p50, quantile_disc(delay, 0.95) AS p95 FROM obs GROUP BY 1, 2, 3) SELECT bpuic, transport, round(avg(p50) + 1e-9, 4) AS p50, round(avg(p95) + 1e-9, 4) AS p95 FROM g GROUP BY 1, 2""")
def a42_fallback_avg(spark, d):
    from slackline.functions.quantiles import exact_percentiles
    from slackline.operators.routes import coarser

    g = observations(spark, d).groupBy("bpuic", "transport", "hour").agg(exact_percentiles(F.col("delay")).alias("quantiles"))
    return coarser(g, ["bpuic", "transport"]).select("bpuic", "transport", R4(F.get("quantiles", F.lit(0))).alias("p50"), R4(F.get("quantiles", F.lit(6))).alias("p95"))


@query(f"WITH {STOP_TIMES}, t AS (SELECT trip_id, count(DISTINCT stop) AS size FROM st GROUP BY 1), m AS (SELECT trip_id, count(DISTINCT stop) AS met FROM st WHERE quantity > 5 GROUP BY 1) SELECT trip_id FROM t JOIN m USING (trip_id) WHERE met = size")
def a43_full_coverage(spark, d):
    st = stop_times(spark, d)
    size = st.groupBy("trip_id").agg(F.count_distinct("stop").alias("size"), F.count_distinct(F.when(F.col("quantity") > 5, F.col("stop"))).alias("met"))
    return size.filter("met = size").select("trip_id")


@query(None)
def a44_approx_quantile(spark, d):
    q = read(spark, d, "events", "value").approxQuantile("value", [0.5, 0.9], 0.001)
    return spark.createDataFrame([tuple(q)], "p50 double, p90 double")


@query(f"WITH {OBSERVATIONS}, h AS (SELECT date_trunc('hour', ts) AS h, bpuic, quantile_disc(delay, 0.9) AS p90 FROM obs GROUP BY 1, 2) SELECT bpuic, round(least(avg(p90), 60) + 1e-9, 4) AS heat FROM h GROUP BY 1")
def a45_heat(spark, d):
    h = observations(spark, d).groupBy(F.date_trunc("hour", "ts").alias("h"), "bpuic").agg(F.percentile_approx("delay", F.lit(0.9), F.lit(1_000_000)).alias("p90"))
    return h.groupBy("bpuic").agg(R4(F.least(F.avg("p90"), F.lit(60.0))).alias("heat"))


@query("SELECT event_id % 5 AS sample, count(*) AS n, round(avg(value) + 1e-9, 4) AS mean, quantile_disc(value, 0.5) AS median, round(stddev(value) + 1e-9, 4) AS sd, round(avg(CASE WHEN value > 120 THEN 1.0::DOUBLE ELSE 0 END) + 1e-9, 4) AS excessive FROM events GROUP BY 1")
def a46_sampling_stability(spark, d):
    g = read(spark, d, "events", "event_id", "value").groupBy((F.col("event_id") % 5).alias("sample"))
    return g.agg(F.count("*").alias("n"), R4(F.avg("value")).alias("mean"), F.percentile_approx("value", F.lit(0.5), F.lit(1_000_000)).alias("median"), R4(F.stddev("value")).alias("sd"), R4(F.avg((F.col("value") > 120).cast("double"))).alias("excessive"))


@query("SELECT min(t) AS first, max(t) AS last FROM (SELECT lpad(CAST(l_quantity AS INTEGER)::VARCHAR, 2, '0') || ':30:00' AS t FROM lineitem)")
def a47_clock_range(spark, d):
    t = clock.clock_text(F.col("l_quantity") * 3600 + 1800)
    return read(spark, d, "lineitem", "l_quantity").agg(F.min(t).alias("first"), F.max(t).alias("last"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def a48_type_histogram(spark, d):
    return read(spark, d, "part", "p_type").groupBy("p_type").agg(F.count("*").alias("n"))


# --- windows ----------------------------------------------------------------------------------------


@query(f"WITH {_CONN} SELECT * FROM conn")
def w1_lead_connections(spark, d):
    return timetable.build_connections(stop_times(spark, d))


@query(f"WITH {OBSERVATIONS} SELECT event_id, row_number() OVER (PARTITION BY operating_day, trip_id ORDER BY secs, event_id)::INTEGER AS seq, count(*) OVER (PARTITION BY operating_day, trip_id)::INTEGER AS length FROM obs")
def w2_trip_seq(spark, d):
    return journeys.sequenced(observations(spark, d)).select("event_id", "seq", "length")


@query(f"WITH {STOPS}, {STATIONS}, p AS (SELECT a.stop, b.station, {_KM} AS km FROM stops a, stations b) SELECT stop, station FROM (SELECT *, row_number() OVER (PARTITION BY stop ORDER BY km, station) AS n FROM p) WHERE n = 1")
def w4_nearest_rank(spark, d):
    return geo.nearest(stops(spark, d), stations(spark), "stop", "station").select("stop", "station")


@query(None)
def w5_stratified_hash(spark, d):
    return journeys.stratified(observations(spark, d).select("event_id", "transport", "hour"), ["transport", "hour"], 10, ["event_id"])


@query(None)
def w5_stratified_rand(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.rand(42))
    return read(spark, d, "events", "event_id", "event_type").withColumn("n", F.row_number().over(w)).filter("n <= 10")


@query("SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY year(o_orderdate)), 6) AS share FROM orders GROUP BY 1, 2")
def w6_share(spark, d):
    g = read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_orderpriority").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("y")), 6))


@query(f"WITH {OBSERVATIONS}, h AS (SELECT date_trunc('hour', ts) AS hour_start, bpuic, quantile_disc(delay, 0.9) AS p90 FROM obs GROUP BY 1, 2) SELECT hour_start::TIMESTAMP AS hour_start, bpuic, p90, rank::INTEGER AS rank FROM (SELECT *, rank() OVER (PARTITION BY hour_start ORDER BY p90 DESC) AS rank FROM h) WHERE rank <= 5")
def w7_hourly_top5(spark, d):
    h = observations(spark, d).groupBy(F.date_trunc("hour", "ts").alias("hour_start"), "bpuic").agg(F.percentile_approx("delay", F.lit(0.9), F.lit(1_000_000)).alias("p90"))
    return features.worst_of_hour(h, "p90")


_SLIDE = f"{OBSERVATIONS}, h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour_start, bpuic, delay, epoch(date_trunc('hour', ts)) AS e FROM obs), s AS (SELECT DISTINCT hour_start, bpuic, quantile_disc(delay, 0.9) OVER (PARTITION BY bpuic ORDER BY e RANGE BETWEEN 10800 PRECEDING AND CURRENT ROW) AS p FROM h)"


@query(f"WITH {_SLIDE} SELECT * FROM s")
def w8_sliding_p90(spark, d):
    return features.sliding_percentile(observations(spark, d), "bpuic", "ts", "delay", 0.9, 3)


@query(f"WITH {_SLIDE} SELECT hour_start, bpuic, p, rank::INTEGER AS rank FROM (SELECT *, rank() OVER (PARTITION BY hour_start ORDER BY p DESC) AS rank FROM s) WHERE rank <= 5")
def w9_sliding_rank(spark, d):
    return features.worst_of_hour(features.sliding_percentile(observations(spark, d), "bpuic", "ts", "delay", 0.9, 3), "p")


@query("SELECT event_type, event_id, value, n::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 10")
def w10_preview_rank(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return read(spark, d, "events", "event_type", "event_id", "value").withColumn("n", F.row_number().over(w)).filter("n <= 10")


# --- order, distinct, samples -----------------------------------------------------------------------


@query(f"WITH {_CONN} SELECT dep_secs, trip_id, dep_seq, dep_stop, arr_stop FROM conn")
def o1_connection_order(spark, d):
    return timetable.build_connections(stop_times(spark, d)).orderBy("dep_secs", "trip_id", "dep_seq").select("dep_secs", "trip_id", "dep_seq", "dep_stop", "arr_stop")


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def o2_sorted_partitions(spark, d):
    return read(spark, d, "lineitem", "l_orderkey", "l_quantity").repartition("l_orderkey").sortWithinPartitions("l_orderkey", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o4_top_n(spark, d):
    return read(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def o5_worst_ten(spark, d):
    return read(spark, d, "events", "event_id", "value").orderBy(F.desc("value"), "event_id").limit(10)


@query(f"WITH {STOPS}, p AS (SELECT a.stop AS a, b.stop AS b, 1000 * {_KM} AS m FROM stops a, stops b WHERE a.stop <> b.stop AND 1000 * {_KM} <= 9000) SELECT a, string_agg(b::VARCHAR, ',' ORDER BY round(m, 3), b) AS nearest FROM p GROUP BY 1")
def o6_walk_order(spark, d):
    p = geo.pairs_within(stops(spark, d), "stop", 9000.0).groupBy("a").agg(F.array_sort(F.collect_list(F.struct(F.round("metres", 3).alias("m"), "b"))).alias("w"))
    return p.select("a", F.array_join(F.transform("w", lambda x: x["b"].cast("string")), ",").alias("nearest"))


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def o7_distinct(spark, d):
    return read(spark, d, "lineitem", "l_suppkey", "l_returnflag").distinct()


@query("SELECT l_suppkey, l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2")
def o8_first_by_key(spark, d):
    return read(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity").groupBy("l_suppkey", "l_partkey").agg(F.min("l_quantity").alias("l_quantity"))


@query(None)
def o9_bernoulli(spark, d):
    return read(spark, d, "events", "event_id").sample(0.1, 42)


@query(None)
def o9_hash_sample(spark, d):
    return read(spark, d, "events", "event_id").filter(journeys.hash_share(0.1, "event_id"))


@query(None)
def o10_sample_by(spark, d):
    return read(spark, d, "events", "event_id", "event_type").sampleBy("event_type", {"view": 0.2, "click": 0.1}, 42)


@query(None)
def o11_random_split(spark, d):
    a, b = read(spark, d, "events", "event_id").randomSplit([0.5, 0.5], 42)
    return a.withColumn("half", F.lit(0)).unionByName(b.withColumn("half", F.lit(1))).groupBy("half").agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, (SELECT min(n) FROM n) AS n FROM n")
def o12_equal_strata(spark, d):
    return journeys.equal_strata(read(spark, d, "events", "event_id", "event_type"), ["event_type"], ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {_CONN}, p AS (SELECT dep_stop, dep_secs AS departure_secs, min(arr_secs + trip_id % 7 * 600)::INTEGER AS arrival_secs FROM conn GROUP BY 1, 2) SELECT dep_stop, departure_secs, arrival_secs FROM (SELECT *, min(arrival_secs) OVER (PARTITION BY dep_stop ORDER BY departure_secs DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p) WHERE best IS NULL OR arrival_secs < best""")
def o13_pareto_frontier(spark, d):
    from slackline.operators.routes import pareto

    c = timetable.build_connections(stop_times(spark, d)).select("dep_stop", F.col("dep_secs").alias("departure_secs"), (F.col("arr_secs") + F.col("trip_id") % 7 * 600).cast("int").alias("arrival_secs"))
    return pareto(c, "dep_stop")


# --- sets -------------------------------------------------------------------------------------------


@query("SELECT event_id, 'val' AS period FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-03' UNION ALL SELECT event_id, 'val' FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-28'")
def u1_union_periods(spark, d):
    o = observations(spark, d)
    return o.filter("operating_day <= '2024-01-03'").select("event_id").union(o.filter("operating_day >= '2024-01-28'").select("event_id")).withColumn("period", F.lit("val"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, NULL::INTEGER AS size FROM orders UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def u2_union_missing(spark, d):
    a = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    b = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT l_suppkey AS k FROM lineitem UNION SELECT s_suppkey FROM supplier")
def u3_union_distinct(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")).distinct().unionByName(read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))).distinct()


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def u4_intersect(spark, d):
    li = read(spark, d, "lineitem", "l_partkey", "l_returnflag")
    return li.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(li.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def u5_except(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(read(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("k")))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS s, l_linenumber AS n FROM lineitem WHERE l_discount < 0.02), b AS (SELECT DISTINCT l_suppkey AS s, l_linenumber AS n FROM lineitem WHERE l_discount > 0.08)
  SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def u6_symmetric_difference(spark, d):
    li = read(spark, d, "lineitem", "l_suppkey", "l_linenumber", "l_discount")
    part = lambda c: li.filter(c).select(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n")).distinct()
    a, b = part("l_discount < 0.02"), part("l_discount > 0.08")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


@query("""WITH a AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE hour(ts) < 12) AS x, list(DISTINCT event_type) FILTER (WHERE hour(ts) >= 12) AS y FROM events GROUP BY 1)
  SELECT user_id, round(coalesce(len(list_intersect(coalesce(x, []), coalesce(y, [])))::DOUBLE / nullif(len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))), 0), 1.0), 6) AS overlap FROM a""")
def u7_jaccard(spark, d):
    e = read(spark, d, "events", "user_id", "event_type", "ts")
    half = lambda c: F.collect_set(F.when(c, F.col("event_type")))
    g = e.groupBy("user_id").agg(half(F.hour("ts") < 12).alias("x"), half(F.hour("ts") >= 12).alias("y"))
    return g.select("user_id", F.round(journeys.jaccard(F.col("x"), F.col("y")), 6).alias("overlap"))
