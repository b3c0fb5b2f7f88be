"""Losses, metrics, calibration and summaries, as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slackline.functions.quantiles import LEVELS, pinball


def pinball_losses(rows: DataFrame, actual: str, predicted: dict[float, str]) -> DataFrame:
    """One row: the mean pinball loss at each level."""
    return rows.agg(*[F.avg(pinball(F.col(actual), F.col(c), q)).alias(f"pinball_{round(q * 100):02d}") for q, c in predicted.items()])


def regression_metrics(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: rmse, mae, r2, bias, 90th and 95th percentile of the absolute error, share of under-predictions."""
    y, e = F.col(actual), F.col(predicted) - F.col(actual)
    # the spread around the mean from sums that merge, as variance does: no pass of its own
    return rows.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"), F.avg(e).alias("bias"),
        F.percentile_approx(F.abs(e), 0.9, 1_000_000).alias("p90_abs"), F.percentile_approx(F.abs(e), 0.95, 1_000_000).alias("p95_abs"), F.avg((e < 0).cast("double")).alias("under_rate"),
    )


def group_baseline(rows: DataFrame, train: DataFrame, keys: Sequence[str], value: str, q: float, name: str = "predicted") -> DataFrame:
    """Each row with the training percentile of its group, or of the whole training table where the group is new."""
    p = F.percentile_approx(value, F.lit(q), F.lit(1_000_000))
    return rows.join(train.agg(p.alias("_all"))).join(train.groupBy(*keys).agg(p.alias("_own")), list(keys), "left").withColumn(name, F.coalesce("_own", "_all")).drop("_own", "_all")


def calibration(rows: DataFrame, actual: str, predicted: dict[float, str]) -> DataFrame:
    """(q, success, mean_buffer_min, gap): how often a level holds, what it costs, and how far it is from its promise."""
    long = rows.select(F.col(actual).alias("y"), F.inline(F.array(*[F.struct(F.lit(q).alias("q"), F.col(c).alias("p")) for q, c in predicted.items()])))
    found = long.groupBy("q").agg(F.avg((F.col("p") >= F.col("y")).cast("double")).alias("success"), (F.avg("p") / 60).alias("mean_buffer_min"))
    return found.withColumn("gap", F.col("success") - F.col("q"))


def replay_summary(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Means over replays, where a null success (no route) is left out of its mean but not of the count."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return results.groupBy(*by).agg(F.count("*").alias("n"), share("std_success"), share("rob_success"), F.avg("std_ms").alias("std_ms"), F.avg("rob_ms").alias("rob_ms"), share("routes_identical"), F.avg("overlap").alias("overlap"))


def latency_stats(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, min, max, p95 (the maximum below 20 rows) and total."""
    p95 = F.when(F.count(value) < 20, F.max(value)).otherwise(F.percentile(value, F.lit(0.95)))
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), p95.alias("p95"), F.sum(value).alias("total")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def bucket_summary(rows: DataFrame, p50: str, p90: str, edges: Sequence[int] = (30, 60, 120, 300)) -> DataFrame:
    """One row: the share of medians in each bucket, the median of them, and the mean of the 90th percentiles."""
    bounds = [None, *edges, None]
    aggs = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        inside: Column = F.lit(True)
        inside = inside & (F.col(p50) >= low) if low is not None else inside
        inside = inside & (F.col(p50) < high) if high is not None else inside
        aggs.append((F.count_if(inside) / F.nullif(F.count("*"), F.lit(0))).alias(f"share_{low or 0}_{high or 'up'}"))
    return rows.agg(*aggs, F.percentile(p50, F.lit(0.5)).alias("median_p50"), F.avg(p90).alias("mean_p90"))


def large_delays(rows: DataFrame, actual: str, predicted: str, q: float = 0.9) -> DataFrame:
    """Errors on the rows at or above a percentile of the actual value, beside those of the mean and the median as predictors."""
    edge = rows.agg(F.percentile_approx(actual, F.lit(q), F.lit(1_000_000)).alias("_edge"), F.avg(actual).alias("_mean"), F.percentile_approx(actual, F.lit(0.5), F.lit(1_000_000)).alias("_median"))
    tail = rows.join(edge).filter(F.col(actual) >= F.col("_edge"))
    mae = lambda c: F.avg(F.abs(F.col(actual) - F.col(c)))
    return tail.agg(F.count("*").alias("n"), mae(predicted).alias("mae"), mae("_mean").alias("mae_mean"), mae("_median").alias("mae_median"))


def elbow(curve: DataFrame, x: str, y: str, width: int = 5, share: float = 0.003) -> DataFrame:
    """The first x whose moving mean changes by less than a share of the whole gain. One curve's points, ordered by x."""
    w = Window.orderBy(x)
    smooth = curve.select(x, F.avg(y).over(w.rowsBetween(-(width - 1), 0)).alias("_s"))
    stepped = smooth.withColumn("_d", F.abs(F.col("_s") - F.lag("_s").over(w)))
    gain = smooth.agg(F.abs(F.max_by("_s", x) - F.min_by("_s", x)).alias("_gain"))
    return stepped.join(gain).filter(F.col("_d") < share * F.col("_gain")).agg(F.min(x).alias("elbow"))


def summary(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    p = F.percentile_approx(value, [0.5, 0.9, 0.95, 0.99], 1_000_000)
    found = (rows.groupBy(*by) if by else rows).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"), p.alias("_p"))
    return found.select(*by, "n", "mean", "sd", "least", "most", *[F.get("_p", F.lit(i)).alias(f"p{k}") for i, k in enumerate((50, 90, 95, 99))])


def divergence(rows: DataFrame, day: str, actual: str, predicted: str, baseline: float, last_days: int = 3, q: float = 0.5, threshold: float = 0.2) -> DataFrame:
    """The loss over the last days, its relative change against a baseline, and whether that is too much."""
    end = rows.agg(F.max(day).alias("_end"))
    recent = rows.join(end).filter(F.col(day) > F.date_sub("_end", last_days))
    loss = recent.agg(F.avg(pinball(F.col(actual), F.col(predicted), q)).alias("loss"))
    change = (F.col("loss") - baseline) / baseline
    return loss.withColumn("change", change).withColumn("retrain", F.col("change") > threshold)


def check_artifact(lookup: DataFrame, key: str = "key", fields: int = 6, low: float = -300.0, high: float = 3600.0) -> DataFrame:
    """One row of counts: keys of the wrong arity, arrays of the wrong length, values out of range, arrays out of order."""
    v = F.col("quantiles")
    return lookup.agg(
        F.count("*").alias("rows"), F.count_if(F.size(F.split(key, "__")) != fields).alias("bad_keys"), F.count_if(F.size(v) != len(LEVELS)).alias("bad_length"),
        F.count_if(F.exists(v, lambda x: (x < low) | (x > high))).alias("out_of_range"), F.count_if(v != F.array_sort(v)).alias("out_of_order"),
    )


def frontier(rows: DataFrame, level: str, minutes: str, success: str) -> DataFrame:
    """(level, minutes, success, efficient): means by level, and whether no other level takes no longer, succeeds no less often and is better in one."""
    means = rows.groupBy(level).agg(F.avg(minutes).alias("minutes"), F.avg(F.col(success).cast("double")).alias("success"))
    rivals = means.agg(F.collect_list(F.struct("minutes", "success")).alias("_all"))  # one entry a level
    beaten = F.exists("_all", lambda x: (x["minutes"] <= F.col("minutes")) & (x["success"] >= F.col("success")) & ((x["minutes"] < F.col("minutes")) | (x["success"] > F.col("success"))))
    return means.join(rivals).select(level, "minutes", "success", (~beaten).alias("efficient"))
