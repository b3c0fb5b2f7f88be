"""Models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from slackline.operators import evaluation, models
from slackline.queries.registry import query, scratch
from slackline.queries.relational import R4
from slackline.sources.roles import OBSERVATIONS, observations
from slackline.sources.tables import read
from slackline.streaming import windows

CATEGORICAL, NUMERIC = ["transport", "dow"], ["hour", "bpuic"]


def _data(spark, d):
    o = observations(spark, d).select("event_id", "operating_day", "transport", F.col("dow").cast("string").alias("dow"), F.col("hour").cast("double").alias("hour"), F.col("bpuic").cast("double").alias("bpuic"), "delay")
    return o.filter("operating_day < '2024-01-21'"), o.filter("operating_day >= '2024-01-21'")


@query(None)
def m1_index_assemble(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    train, test = _data(spark, d)
    out = Pipeline(stages=models.feature_stages(CATEGORICAL, NUMERIC)).fit(train).transform(test)
    return out.select("event_id", vector_to_array("features").alias("features"))


@query(f"""WITH {OBSERVATIONS}, t AS (SELECT * FROM obs WHERE operating_day < DATE '2024-01-21'), a AS (SELECT transport, hour, dow, quantile_disc(delay, 0.5) AS p50, quantile_disc(delay, 0.9) AS p90 FROM t GROUP BY 1, 2, 3 HAVING count(*) >= 5), b AS (SELECT transport, quantile_disc(delay, 0.5) AS p50, quantile_disc(delay, 0.9) AS p90 FROM t GROUP BY 1 HAVING count(*) >= 5)
  SELECT event_id, coalesce(a.p50, b.p50) AS p50, coalesce(a.p90, b.p90) AS p90 FROM obs LEFT JOIN a USING (transport, hour, dow) LEFT JOIN b USING (transport) WHERE operating_day >= DATE '2024-01-21'""")
def m2_group_quantile_model(spark, d):
    """Fitted, saved, loaded and applied."""
    o = observations(spark, d)
    keys = [["transport", "hour", "dow"], ["transport"]]
    path = scratch(spark, "quantiles")
    models.QuantileModel.fit(o.filter("operating_day < '2024-01-21'"), keys, "delay").save(path)
    out = models.QuantileModel.load(spark, path, keys).predict(o.filter("operating_day >= '2024-01-21'"))
    return out.select("event_id", F.get("quantiles", F.lit(0)).alias("p50"), F.get("quantiles", F.lit(5)).alias("p90"))


@query(None)
def m2_linear_quantile(spark, d):
    train, test = _data(spark, d)
    w = models.pinball_linear(train, NUMERIC, "delay", 0.9)
    p = F.lit(w[-1]) + sum(F.lit(a) * F.col(c) for a, c in zip(w, NUMERIC, strict=False))
    return evaluation.pinball_losses(test.withColumn("p", p), "delay", {0.9: "p"})


@query(None)
def m3_one_hot_linear(spark, d):
    train, test = _data(spark, d)
    out = models.baseline("linear", CATEGORICAL, NUMERIC, "delay").fit(train).transform(test)
    return evaluation.regression_metrics(out, "delay", "prediction")


@query(None)
def m4_trees(spark, d):
    train, test = _data(spark, d)
    found = None
    for kind, settings in (("tree", {"maxDepth": 4}), ("forest", {"maxDepth": 4, "numTrees": 8})):
        out = models.baseline(kind, CATEGORICAL, NUMERIC, "delay", **settings).fit(train).transform(test)
        row = evaluation.regression_metrics(out, "delay", "prediction").withColumn("model", F.lit(kind))
        found = row if found is None else found.unionByName(row)
    return found


@query(f"WITH {OBSERVATIONS}, t AS (SELECT avg(delay) AS m FROM obs WHERE operating_day < DATE '2024-01-21') SELECT round(sqrt(avg(pow(delay - m, 2))) + 1e-9, 4) AS rmse, round(avg(abs(delay - m)) + 1e-9, 4) AS mae FROM obs, t WHERE operating_day >= DATE '2024-01-21'")
def m4_mean_baseline(spark, d):
    train, test = _data(spark, d)
    m = evaluation.regression_metrics(test.join(train.agg(F.avg("delay").alias("p"))), "delay", "p")
    return m.select(R4("rmse").alias("rmse"), R4("mae").alias("mae"))


@query(f"WITH {OBSERVATIONS}, k AS (SELECT DISTINCT bpuic, transport, hour FROM obs WHERE operating_day < DATE '2024-01-21') SELECT DISTINCT bpuic, transport, hour FROM obs WHERE operating_day >= DATE '2024-01-21' EXCEPT SELECT * FROM k")
def m6_live_misses(spark, d):
    o = observations(spark, d)
    return models.distinct_misses(o.filter("operating_day >= '2024-01-21'"), o.filter("operating_day < '2024-01-21'"), ["bpuic", "transport", "hour"])


@query(None)
def m8_save_load(spark, d):
    train, test = _data(spark, d)
    path = scratch(spark, "model")
    models.save(models.baseline("linear", CATEGORICAL, NUMERIC, "delay").fit(train), path)
    return models.load(path).transform(test).select("event_id", "prediction")


@query(None)
def d45_cross_validation(spark, d):
    o = observations(spark, d).select(F.col("transport"), F.col("dow").cast("string").alias("dow"), F.col("hour").cast("double").alias("hour"), F.col("bpuic").cast("double").alias("bpuic"), "delay", (F.dayofmonth("operating_day") % 4).alias("fold"))
    return models.cross_validate(o, "fold", {"linear": models.baseline("linear", CATEGORICAL, NUMERIC, "delay")}, "delay")


@query(None)
def d46_grid_search(spark, d):
    train, test = _data(spark, d)
    best, rmse = models.grid_search(train, test, "delay", lambda **g: models.baseline("tree", CATEGORICAL, NUMERIC, "delay", **g), [{"maxDepth": 2}, {"maxDepth": 4}])
    return spark.createDataFrame([(best["maxDepth"], rmse)], "depth int, rmse double")


def _stream(spark, d, name):
    """events written as a stream's input folder in event time, hour by hour files left to Spark, and read as one."""
    path = scratch(spark, name)
    observations(spark, d).select("event_id", "ts", "bpuic", "user_id", "delay").withColumn("cents", F.round(F.col("delay") * 100).cast("long")).write.parquet(path)
    return windows.read_stream(spark, path)


def _drained(spark, stream, name):
    """All windows: append mode holds back those the watermark hasn't passed, so the result is taken in complete form by a batch of the same function."""
    out = scratch(spark, name)
    return windows.run_available(stream, f"{out}/table", f"{out}/checkpoint")



@query("SELECT * FROM (SELECT time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP AS start, CAST(json_extract_string(props, '$.k') AS INTEGER) AS bpuic, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total, max(round(value * 100)::BIGINT) AS most FROM events GROUP BY 1, 2) WHERE start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '2 hours' FROM events)")
def x1_tumbling(spark, d):
    """Windows that the watermark has passed, as a stream writes them."""
    return _drained(spark, windows.tumbling(_stream(spark, d, "tumbling"), "bpuic", "cents"), "tumbling")


@query("WITH e AS (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour', time_bucket(INTERVAL '1 hour', ts) - INTERVAL '2 hours']) AS start, user_id, round(value * 100)::BIGINT AS cents FROM events) SELECT start::TIMESTAMP AS start, user_id, count(*) AS n, sum(cents)::BIGINT AS total, max(cents) AS most FROM e GROUP BY 1, 2 HAVING start + INTERVAL '3 hours' <= (SELECT max(ts) - INTERVAL '2 hours' FROM events)")
def x2_sliding(spark, d):
    return _drained(spark, windows.sliding(_stream(spark, d, "sliding"), "user_id", "cents"), "sliding")


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '45 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e)
  SELECT min(ts)::TIMESTAMP AS start, user_id, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM s GROUP BY user_id, g HAVING max(ts) + INTERVAL '45 minutes' <= (SELECT max(ts) - INTERVAL '2 hours' FROM events)""")
def x3_session(spark, d):
    return _drained(spark, windows.sessions(_stream(spark, d, "sessions"), "user_id", "cents"), "sessions")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def x4_stream_dedup(spark, d):
    """Every report comes twice; one of each stays."""
    path = scratch(spark, "twice")
    o = observations(spark, d).select("event_id", "ts", "bpuic")
    o.unionByName(o).write.parquet(path)
    out = _drained(spark, windows.first_reports(windows.read_stream(spark, path), ["event_id"]), "dedup")
    return out.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("""WITH e AS (SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events) SELECT a.event_id AS a_id, b.event_id AS b_id FROM e a JOIN e b ON a.k = b.k AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '45 minutes' WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def x5_stream_join(spark, d):
    path = scratch(spark, "meet")
    observations(spark, d).select("event_id", "ts", "bpuic", "transport").write.parquet(path)
    left = windows.read_stream(spark, path).filter("transport = 'view'")
    right = windows.read_stream(spark, path).filter("transport = 'click'")
    return _drained(spark, windows.meetings(left, right, "bpuic"), "meetings").select("a_id", "b_id")


@query("SELECT CAST(ts AS DATE) AS operating_day, count(*) AS n FROM events GROUP BY 1", days=("operating_day",))
def x6_each_batch(spark, d):
    """Days appended by micro-batches, each written to a place of its own, so a repeated batch replaces itself."""
    path = scratch(spark, "batches")
    observations(spark, d).select("event_id", "operating_day").repartition(4).write.parquet(f"{path}/in")
    stream = windows.read_stream(spark, f"{path}/in")
    windows.each_batch(stream, lambda rows, k: rows.write.mode("overwrite").parquet(f"{path}/out/batch={k}"), f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").groupBy("operating_day").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM events")
def s3_parquet_read(spark, d):
    return read(spark, d, "events", "event_id").agg(F.count("*").alias("n"))
