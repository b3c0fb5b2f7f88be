"""Every operator on nasty, empty and tiny tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slackline.llm import additive_search, mixing, near_duplicates, packing, personal_data, quality_ranker, quality_rules, token_counts, toxicity, warc
from slackline.llm.queries import vocabulary
from tests.llm.nasty import empty_docs, nasty_docs, nasty_labels, nasty_rows


def by_row(df, *columns):
    return sorted(df.select(*columns).collect(), key=repr)


OPERATORS = {
    "ranker": lambda d, l: quality_ranker.quality_scores(d, l), "mixing": lambda d, l: mixing.mix_sources(d), "personal": lambda d, l: personal_data.span_digests(d), "toxicity": lambda d, l: toxicity.toxicity_scores(d, l),
    "near": lambda d, l: near_duplicates.near_duplicates(d), "rules": lambda d, l: quality_rules.quality_verdicts(d), "counts": lambda d, l: token_counts.token_counts(d, vocabulary()), "packing": lambda d, l: packing.pack_documents(d, vocabulary()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nasty_tables(spark, name):
    out = OPERATORS[name](nasty_docs(spark), nasty_labels(spark))
    rows = out.collect()
    if name not in ("mixing", "packing"):
        assert len(rows) == len(nasty_rows())
    assert len(out.columns) == len(set(out.columns))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](empty_docs(spark), nasty_labels(spark)).collect() == []
    assert OPERATORS[name](empty_docs(spark), nasty_labels(spark).limit(0)).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, k):
    _, stage = corpus_pipeline.STAGES[k]
    docs = nasty_docs(spark)
    out = stage(spark, docs, "")
    rows = out.collect()
    assert rows
    if k < 4:
        assert out.columns == docs.columns
        assert {r["copy"] for r in rows} == {7} and {r["_text"] for r in rows} == {"clash"}
    empty = stage(spark, empty_docs(spark), "")
    assert empty.collect() == []


def test_mixing_with_clashing_columns(spark):
    docs = nasty_docs(spark).withColumn("levels", F.lit("x")).withColumn("_u", F.lit(2)).withColumn("rate", F.lit(0))
    plain = mixing.resample(docs).collect()
    mixed = mixing.mix_sources(docs).collect()
    assert len(plain) == len(mixed) and {r["levels"] for r in plain} == {"x"} and all(1 <= r["copy"] <= r["copies"] for r in mixed)


def test_labels_of_one_class(spark):
    labels = nasty_labels(spark).filter("quality = 1 and toxic = 0")
    scores = [r["score"] for r in quality_ranker.quality_scores(nasty_docs(spark), labels).collect()]
    assert set(scores) == {0.5}
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity_scores(nasty_docs(spark), labels).collect())


def test_warc_edges(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>", "x"), (2, None, "<p>é</p>", "x"), (2, None, "<p>é</p>", "x"), (3, "u", None, "x"), (4, "u", "", "x"), (None, "u", "", "x"), (None, None, None, "x"), (5, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb", "x"), (6, "u", "z" * 3_000_000, "x"), (None, "u", "only", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    out = warc.archive_round_trip(pages).collect()
    assert len(out) == len(rows)
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out}
    assert got == {(1, 9, "revisit", 2), (2, 9, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 0, "revisit", 4), (5, 18, "response", None), (6, 3_000_000, "response", None), (None, 4, "response", None)}
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


def test_warc_pages_with_several_payloads(spark):
    rows = [(1, "u", "a"), (1, "u", "bbb"), (0, "u", "a"), (-1, "u", "bbb"), (1, "u", "a"), (7, "u", ""), (7, "u", None), (None, "u", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    want = sorted(con.execute(warc.ORACLE).fetchall(), key=repr)
    got = warc.archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert {(r["page_id"], r["payload_bytes"]) for r in got if r["page_id"] in (0, -1)} == {(0, 1), (-1, 3)}


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.5, 0.5, 0.5]), (None, [1.0, 1.0]), (20, [-1.0, 2.0]), (9, []), (10, [3.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    out = additive_search.nearest(table).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out] == [
        (0, 1, 10, 3.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -1.0), (20, 3, 2, -1.0), (20, 4, 10, -1.0),
    ]
    assert additive_search.nearest(table.limit(0)).collect() == []
    assert additive_search.nearest(table.filter("vec_id = 20")).collect() == []


def test_near_results(spark):
    out = near_duplicates.near_duplicates(nasty_docs(spark)).withColumn("i", F.monotonically_increasing_id())
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["component_id"], r["kept"]))
    # 2 has two texts: one equal to 1's, one equal to -5's, so all of them are one document
    assert {c for k in (1, 2, -5, 13) for c, _ in got[k]} == {-5}
    assert got[3] == [(3, True)] and got[4] == [(4, True)] and got[5] == [(5, True)]
    assert got[7] == [(6, False)] and got[9] == [(8, False)]
    assert set(got[None]) == {(None, True)}
