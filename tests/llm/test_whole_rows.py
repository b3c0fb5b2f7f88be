"""Rows of repeated and null ids in deduplication."""

from slackline.llm import near_duplicates
from tests.llm.nasty import prose


def test_no_text_is_lost_by_its_id(spark):
    b = " ".join(f"b{k}" for k in range(200))
    rows = [(5, prose(200, 1)), (5, b), (9, b + " more"), (None, "null one two three"), (None, "null one two three"), (None, "quite another text"), (None, b), (7, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int").repartition(1).sortWithinPartitions("place")
    kept = near_duplicates.deduplicate(docs, near_duplicates.NearParameters()).collect()
    assert sorted(r["place"] for r in kept) == [0, 1, 3, 5, 7, 8]
