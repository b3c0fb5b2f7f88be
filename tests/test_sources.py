"""Reading, writing and upkeep of tables, and the streaming helpers."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from slackline.sources import tables
from slackline.streaming import windows


def test_create_once(spark):
    one, two = spark.range(1), spark.range(2)
    assert tables.create_once(spark, "slackline_once", one).count() == 1
    assert tables.create_once(spark, "slackline_once", two).count() == 1
    assert tables.create_once(spark, "slackline_once", two, force=True).count() == 2
    spark.sql("DROP TABLE slackline_once")


def test_source_days(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.csv").write_text(f"BETRIEBSTAG;FAHRT_BEZEICHNER;NEU\n0{k}.01.2024;t{k};x\n", encoding="utf-8")
    rows = tables.read_days(spark, [f"file://{tmp_path}/{k}.csv" for k in (1, 2)])
    assert rows.columns == ["operating_day", "trip_id"] and sorted(r["trip_id"] for r in rows.collect()) == ["t1", "t2"]
    with pytest.raises(ValueError):
        tables.read_days(spark, [])


def test_dynamic_overwrite_touches_only_its_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(100).withColumn("k", F.col("id") % 4)
    tables.write_partitions(rows, path, ["k"], dynamic=False)
    tables.write_partitions(rows.filter("k = 1 and id < 10"), path, ["k"])
    assert {r["k"]: r["count"] for r in spark.read.parquet(path).groupBy("k").count().collect()} == {0: 25, 1: 3, 2: 25, 3: 25}
    tables.write_partitions(rows.filter("k = 2"), path, ["k"], dynamic=False)
    assert spark.read.parquet(path).count() == 25


def test_append_follows_the_declared_schema(spark, tmp_path):
    from pyspark.sql import types as T

    path, schema = f"file://{tmp_path}/t", T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    tables.append(spark.createDataFrame([("7", 1.5, "gone")], "a string, c double, d string"), path, schema)
    tables.append(spark.createDataFrame([("x", 8)], "b string, a long"), path, schema)
    assert sorted(tuple(r) for r in spark.read.schema(schema).parquet(path).collect()) == [(7, None), (8, "x")]


def test_retention_and_newest(spark):
    rows = spark.createDataFrame([(date(2024, 1, d), v) for d, v in ((1, 1), (1, 2), (2, 3), (5, 4))], "day date, v int")
    assert sorted(r["v"] for r in tables.retain(rows, "day", 1).collect()) == [3, 4]
    assert [r["v"] for r in tables.newest(rows, "day").collect()] == [4]
    assert tables.retain(rows.limit(0), "day", 3).isEmpty()


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, 60 * (i * 37 % 600), i % 3, i % 11) for i in range(300)], "event_id long, s long, bpuic int, v long").withColumn("ts", F.timestamp_seconds("s"))
    rows.write.parquet(f"file://{tmp_path}/in")
    batch = {(r["start"], r["bpuic"]): (r["n"], r["total"]) for r in windows.tumbling(rows, "bpuic", "v").collect()}
    stream = windows.tumbling(windows.read_stream(spark, f"file://{tmp_path}/in"), "bpuic", "v")
    got = {(r["start"], r["bpuic"]): (r["n"], r["total"]) for r in windows.run_available(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").collect()}
    assert got and all(batch[k] == v for k, v in got.items()) and len(got) >= len(batch) - 3 * 4
