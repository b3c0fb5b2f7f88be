"""Members of large open buckets are dealt to few cells, and every pair that has to be compared meets in one."""

import itertools

import pytest

from slackline.llm import near_duplicates


def _dealt(spark, buckets, component):
    members = spark.createDataFrame([(k, n, 9) for k, nodes in buckets.items() for n in nodes], "key long, node long, n_shingles long")
    placed = spark.createDataFrame([(n, c) for n, c in component.items() if n != c], "node long, component long")
    return near_duplicates._cells(members, placed).collect()


def _pairs(rows):
    """What _cell_pairs() compares, by its rule for blocks, without its filters."""
    found = set()
    for _, cell in itertools.groupby(sorted(rows, key=lambda r: (r["united"], r["key"], r["i"], r["j"])), key=lambda r: (r["united"], r["key"], r["i"], r["j"])):
        cell = list(cell)
        for x, y in itertools.product(cell, cell):
            if x["c"] != y["c"] and x["own"] == x["i"] and y["own"] == x["j"]:
                found.add((min(x["node"], y["node"]), max(x["node"], y["node"])))
    return found


def _family(home, strays, buckets=6):
    """One component of ``home`` members and ``strays`` beside it; each bucket lacks another tenth of them."""
    nodes = range(home + strays)
    component = {n: 0 if n < home else n for n in nodes}
    return {100 + k: [n for n in nodes if n % 10 != k] for k in range(buckets)}, component


@pytest.fixture
def blocks(monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)


def test_family_is_dealt_once(spark, blocks):
    few, more = (_dealt(spark, *_family(n, 10)) for n in (150, 600))
    assert len(few) < 2 * 160 and len(more) < 4 * len(few) < 6 * 600  # to all pairs of blocks, bucket by bucket: 6 * 144 * 9 and 6 * 549 * 35


@pytest.mark.parametrize("home, strays", [(200, 20), (20, 60), (1, 90), (15, 1)])
def test_all_pairs_meet(spark, blocks, home, strays):
    buckets, component = _family(home, strays)
    buckets |= {7: list(range(home + strays - 1, home + strays + 40)), 8: [3, home + strays + 50], 9: list(range(home))}
    component |= {n: n for n in range(home + strays, home + strays + 60)}
    rows = _dealt(spark, buckets, component)
    wanted = {(a, b) for k, nodes in buckets.items() if len(nodes) > 2 for a, b in itertools.combinations(nodes, 2) if component[a] != component[b]}
    assert wanted <= _pairs(rows)
    sizes = [len(list(g)) for _, g in itertools.groupby(sorted((r["united"], r["key"], r["i"], r["j"]) for r in rows))]
    assert max(sizes) < 5 * 16
