"""Queries against SQL or brute force over whole tables, where the registered SQL reads a share of the ids."""

import heapq

import duckdb
import pytest

from slackline.queries import QUERIES
from slackline.queries.domain import _NODES
from slackline.sources.roles import OBSERVATIONS, STOP_TIMES


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in "orders lineitem events supplier".split():
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def same(spark, small, sql, name, text):
    """The rows of a query, which are those of the text; columns come in the text's order."""
    got = QUERIES[name](spark, small)
    want = sql.execute(text)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(r) for r in got.select(*columns).collect())
    assert rows == sorted(want.fetchall())
    return rows


def test_add_delays_to_every_ride(spark, small, sql):
    whole = f"WITH {STOP_TIMES}, {OBSERVATIONS}, q AS (SELECT bpuic, quantile_disc(delay, 0.9) AS p90 FROM obs GROUP BY 1) SELECT trip_id, stop_sequence, coalesce(p90, 0.0) AS predicted FROM st LEFT JOIN q ON bpuic = stop"
    rows = same(spark, small, sql, "d51_add_delays", whole)
    assert len(rows) == sql.execute("SELECT count(*) FROM lineitem").fetchone()[0]


def test_align_all_trips(spark, small, sql):
    st = sql.execute(f"WITH {STOP_TIMES} SELECT trip_id, stop, stop_sequence, arr_secs FROM st").fetchall()
    stops, at = {}, {}
    for trip, stop, k, secs in st:
        stops.setdefault(trip, set()).add(stop)
        at.setdefault((stop, trip % 3, None if k == 1 else k, secs), set()).add(trip)
    met = {}
    for trip, stop, k, secs in st:
        for other in at[stop, trip % 3, None if k == 1 else k, secs]:
            met.setdefault((trip, other), set()).add(stop)
    want = sorted((trip, f"2024-01-{1 + other % 5:02d}", other) for (trip, other), found in met.items() if found == stops[trip])
    got = QUERIES["j23_null_safe_align"](spark, small).select("trip_id", "day", "obs_trip").collect()
    assert sorted(map(tuple, got)) == want
    assert {trip for trip, _, _ in want} == set(stops)


def test_frontier_of_every_query(spark, small, sql):
    best = {}
    for trip, stop, secs in sql.execute(f"WITH {STOP_TIMES} SELECT trip_id, stop, arr_secs FROM st").fetchall():
        at = best.setdefault(trip, {})
        at[secs] = min(at.get(secs, 10**9), secs + stop * 60)
    want = sorted((trip, dep, arr) for trip, at in best.items() for dep, arr in at.items() if all(arr < a for t, a in at.items() if t > dep))
    got = QUERIES["d58_sampled_frontier"](spark, small).select("query_id", "departure_secs", "arrival_secs").collect()
    assert sorted(map(tuple, got)) == want


def test_walks_from_every_stop(spark, small, sql):
    edges = {}
    for a, b, metres in sql.execute(f"WITH {_NODES} SELECT a0, b0, metres FROM edge").fetchall():
        edges.setdefault(a, []).append((b, metres))
    want = {}
    for (source,) in sql.execute("SELECT s_suppkey FROM supplier").fetchall():
        heap, done = [(0.0, source)], {}
        while heap:
            metres, node = heapq.heappop(heap)
            if node not in done:
                done[node] = metres
                for b, more in edges.get(node, []):
                    if metres + more <= 45_000:
                        heapq.heappush(heap, (metres + more, b))
        want |= {(source, node): metres for node, metres in done.items()}
    got = {(r["source"], r["node"]): r["metres"] for r in QUERIES["d7_walk_relaxation"](spark, small).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - m) < 0.01 for k, m in want.items())


def test_symmetric_difference_of_all_rows(spark, small, sql, tmp_path):
    part = "SELECT l_suppkey AS s, l_linenumber AS n FROM lineitem WHERE l_discount"
    whole = f"SELECT *, 'left' AS side FROM ({part} < 0.02 EXCEPT {part} > 0.08) UNION ALL SELECT *, 'right' FROM ({part} > 0.08 EXCEPT {part} < 0.02)"
    same(spark, small, sql, "u6_symmetric_difference", whole)
    values = "(1, 7, 1, 0.01), (2, 7, 1, 0.01), (3, 8, 2, 0.01), (50, 8, 2, 0.09), (51, 9, 3, 0.1), (52, 9, 4, 0.05)"
    sql.execute(f"COPY (SELECT * FROM (VALUES {values}) t(l_orderkey, l_suppkey, l_linenumber, l_discount)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    rows = QUERIES["u6_symmetric_difference"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [(7, 1, "left"), (9, 3, "right")]


def test_full_outer_of_all_orders(spark, small, sql):
    part = "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, count(*) AS n FROM orders WHERE o_orderstatus ="
    rows = same(spark, small, sql, "j25_full_outer", f"SELECT day, coalesce(a.n, 0) AS n_f, coalesce(b.n, 0) AS n_o FROM ({part} 'F' GROUP BY 1) a FULL JOIN ({part} 'O' GROUP BY 1) b USING (day)")
    assert sum(f + o for _, f, o in rows) == sql.execute("SELECT count(*) FROM orders WHERE o_orderstatus IN ('F', 'O')").fetchone()[0]


def test_signature_of_stops_in_one_second(spark, tmp_path):
    """A trip that is at two stops in one second makes routes that differ in their stops only: they are one in the SQL."""
    from datetime import datetime

    from slackline.queries import ORACLES

    at = lambda h, m: datetime(2024, 1, 1, h, m)
    events = [(1, at(8, 0), 1, 5), (2, at(8, 0), 1, 6), (3, at(8, 30), 1, 7), (4, at(9, 0), 2, 7), (5, at(9, 30), 2, 8)]
    con = duckdb.connect()
    con.execute("create table events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("insert into events values (?, ?, ?, 'view', 1.0, '{\"k\": ' || ? || '}')", events)
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    rows = [tuple(r) for r in QUERIES["d21_route_signature"](spark, str(tmp_path)).collect()]
    assert rows == con.execute(ORACLES["d21_route_signature"]).fetchall() == [(2, 1)]


def test_signatures_of_tied_trips_only(spark, tmp_path):
    """40 trips onto a stop and 40 off it make 1,600 routes, which aren't shuffled to be told apart, as no trip is at two stops in one second."""
    times = "TIMESTAMP '2024-01-01 08:00:00' + to_seconds(u + CASE WHEN u < 40 THEN 60 * n ELSE 3600 + 60 * n END)"
    stop = "CASE WHEN (u < 40) = (n = 1) THEN 7 ELSE 1000 + u END"
    duckdb.connect().execute(f"""copy (select 2 * u + n as event_id, {times} as ts, u as user_id, 'view' as event_type, 1.0::DOUBLE as value, '{{"k": ' || {stop} || '}}' as props
      from range(80) a(u), range(2) b(n)) to '{tmp_path}/events.parquet' (format parquet)""")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = QUERIES["d21_route_signature"](spark, str(tmp_path))
        rows = [tuple(r) for r in found.collect()]
        nodes, written = [found._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(k) for k in range(node.children().size())]
            metric = node.metrics().get("shuffleRecordsWritten")
            written += metric.get().value() if metric.isDefined() else 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert rows == [(1600, 1600)]
    assert 0 < written < 1600
