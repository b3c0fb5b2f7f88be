"""Queries that judge journeys by their wait: as the journey itself is judged, and once a wait."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slackline.operators import journeys, routes
from slackline.queries import domain
from slackline.queries.registry import QUERIES

DAY = datetime(2024, 1, 5)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Rides into stops of many numbers (negative ones and none, too), and rides on from there after the shortest and longest waits and beside them."""
    rows = []

    def event(user, secs, stop):
        props = "{}" if stop is None else f'{{"k": {stop}}}'
        rows.append((len(rows), DAY + timedelta(seconds=secs), user, "view", 1.0, props))

    for n, stop in enumerate((0, 1, 2, 3, 4, 5, -1, -2, -3, None)):
        event(100 * n, 1000, 50)
        event(100 * n, 2000, stop)
        for k, wait in enumerate((0, 119, 120, 121, 180, 181, 679, 680, 681, 21_599, 21_600, 21_601)):
            event(100 * n + 1 + k, 2000 + wait, stop)
            event(100 * n + 1 + k, 3000 + wait, 60)
    path = tmp_path_factory.mktemp("waits")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


def _leaves(plan):
    found = plan.collectLeaves()
    return [found.apply(k).nodeName() for k in range(found.size())]


def _nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from _nodes(plan.children().apply(k))


def _judges_waits_only(df):
    """No lambda runs on a row that comes from a stored table."""
    judging = [n for n in _nodes(df._jdf.queryExecution().optimizedPlan()) if "lambda" in n.simpleString(100_000)]
    assert judging and all(set(_leaves(n)) == {"Range"} for n in judging)


def test_confidence_by_wait(spark, folder):
    found = QUERIES["d12_route_confidence"](spark, folder)
    _judges_waits_only(found)
    each = domain._legs_with_steps(spark, folder)
    each = each.select("leg1_trip", "leg2_trip", "leg1_dep", "leg2_arr", F.round(routes.confidence(F.col("steps"), F.col("deadline_secs")) + 1e-9, 6))
    assert sorted(found.collect()) == sorted(tuple(r) for r in each.collect()) and found.count() == 9 * 9


def test_replay_by_wait(spark, folder):
    found = QUERIES["d33_replay_success"](spark, folder)
    _judges_waits_only(found)
    real = lambda stop: 500 if stop % 3 == 0 else 60
    each = journeys.transfers(journeys.sequenced(domain.observations(spark, folder)), 1, high=21_600).collect()
    by_hand = sorted((r["leg1_trip"], r["leg2_trip"], r["leg1_dep"], r["leg2_arr"], r["leg2_dep"] - (r["leg1_arr"] + real(r["leg2_from"])) - 60 >= 120) for r in each)
    assert sorted(tuple(r) for r in found.collect()) == by_hand and len(by_hand) == 9 * 9 and len({r[4] for r in by_hand}) == 2
