"""Chains of patterns and values, and long local parts, in personal data."""

import pytest

from slackline.llm import personal_data


def test_chains_of_many_hops(spark):
    rows = []
    for hop, size in enumerate([243, 81, 27, 9, 3]):
        for i in range(size):
            kind = 3 if hop == 0 else None
            rows += [(f"{hop}-{i}", kind, [3], [f"{p} w{c}" for p in ("L1", "L2", "R1")]) for c in {max(hop, 1), hop + 1}]
    found = spark.createDataFrame(rows, "value string, kind long, may array<long>, patterns array<string>")
    got = {r["value"] for r in personal_data.discover(found).collect()}
    assert got == {value for value, kind, _, _ in rows if kind is None}
    with pytest.raises(RuntimeError):
        personal_data.discover(found, 2)


def test_whole_local_part():
    text = "x" * 100 + " at example.org"
    assert personal_data.candidates(text, []) == [(0, len(text), [0])]
    assert len(personal_data.candidates("a at b.c " * 50_000, [])) == 50_000
