"""Joins on keys that very many rows have are split over several tasks."""

import pytest
from pyspark.sql import functions as F

from slackline.llm import components, near_duplicates, storage, warc

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "0",
}


@pytest.fixture
def split(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)

    def plan(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    yield plan
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_payload(spark, split):
    pages = spark.range(30_000).select(F.col("id").alias("page_id"), F.sha2(F.concat(F.lit("u"), F.col("id").cast("string")), 512).alias("url"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.sha2(F.col("id").cast("string"), 512)).alias("html")).repartition(16)
    assert "skew=true" in split(warc.resolve_revisits(storage.written(pages, "test-pages")))


@pytest.mark.parametrize("small", [False, True])
def test_hot_hub(spark, split, small):
    """Large-star meets its many larger neighbours at the hub, small-star its many smaller ones."""
    hub = 1_000_000 if small else 0
    edges = spark.range(60_000).select((F.col("id") + 1).alias("a"), F.when(F.col("id") % 2 == 0, hub).otherwise(F.col("id")).cast("long").alias("b")).filter("a <> b").repartition(16)
    assert "skew=true" in split(components._star(storage.written(edges, "test-edges"), small))


def test_hot_bucket(spark, split):
    members = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("key"), F.col("id").alias("node"), F.lit(9).cast("long").alias("n_shingles"))
    members = storage.written(members.repartition(16), "test-members")
    placed = storage.written(spark.range(5, 10).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("component")), "test-placed")
    cells = near_duplicates._cells(members, placed)
    assert "skew=true" in split(cells)
    sizes = [r["count"] for r in cells.groupBy("key", "i", "j").count().collect()]
    assert max(sizes) < 3 * near_duplicates.BLOCK
