"""Delay models on Spark ML, and the grouped-percentile quantile model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackline.functions.quantiles import exact_percentiles

ESTIMATORS = {"linear": LinearRegression, "tree": DecisionTreeRegressor, "forest": RandomForestRegressor}


def feature_stages(categorical: Sequence[str], numeric: Sequence[str], one_hot: bool = False) -> list:
    """Indexers that keep unknown labels as one more index, one-hot encoders if asked for, and the assembler."""
    indexed = [f"{c}_idx" for c in categorical]
    stages = [StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep", stringOrderType="frequencyDesc")]
    if one_hot:
        coded = [f"{c}_hot" for c in categorical]
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=coded, handleInvalid="keep"))
        indexed = coded
    return [*stages, VectorAssembler(inputCols=[*indexed, *numeric], outputCol="features", handleInvalid="keep")]


def baseline(kind: str, categorical: Sequence[str], numeric: Sequence[str], label: str, **settings) -> Pipeline:
    one_hot = kind == "linear"
    if not one_hot:
        settings = {"maxBins": 256, "seed": 42} | settings
    return Pipeline(stages=[*feature_stages(categorical, numeric, one_hot), ESTIMATORS[kind](labelCol=label, featuresCol="features", **settings)])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


class QuantileModel:
    """Seven percentiles by key, from the finest key set that knows the row down to the whole table.

    A lookup has a row a key and is a table, so it is saved, loaded and joined as one.
    """

    def __init__(self, tables: list[tuple[list[str], DataFrame]], whole: DataFrame):
        self.tables, self.whole = tables, whole

    @classmethod
    def fit(cls, train: DataFrame, key_sets: Sequence[Sequence[str]], label: str, least: int = 5) -> QuantileModel:
        p = exact_percentiles(F.col(label))
        tables = [(list(k), train.groupBy(*k).agg(F.count("*").alias("_n"), p.alias("quantiles")).filter(F.col("_n") >= least).drop("_n")) for k in key_sets]
        return cls(tables, train.agg(p.alias("quantiles")))

    def predict(self, rows: DataFrame) -> DataFrame:
        result = rows
        for i, (keys, table) in enumerate(self.tables):
            result = result.join(table.withColumnRenamed("quantiles", f"_q{i}"), keys, "left")
        result = result.join(self.whole.withColumnRenamed("quantiles", "_q"))
        names = [f"_q{i}" for i in range(len(self.tables))]
        return result.withColumn("quantiles", F.array_sort(F.coalesce(*names, "_q"))).drop(*names, "_q")

    def save(self, path: str) -> None:
        for i, (_, table) in enumerate(self.tables):
            table.write.mode("overwrite").parquet(f"{path}/level{i}")
        self.whole.write.mode("overwrite").parquet(f"{path}/whole")

    @classmethod
    def load(cls, spark, path: str, key_sets: Sequence[Sequence[str]]) -> QuantileModel:
        return cls([(list(k), spark.read.parquet(f"{path}/level{i}")) for i, k in enumerate(key_sets)], spark.read.parquet(f"{path}/whole"))


def pinball_linear(train: DataFrame, features: Sequence[str], label: str, q: float, rounds: int = 25, least: float = 1e-3) -> list[float]:
    """Coefficients (the intercept last) of a linear quantile regression.

    Iteratively reweighted least squares: a residual r weighs q / |r| above the line and (1 - q) / |r|
    below it, which makes the square loss the pinball loss. A round is one aggregation to the sums of
    the normal equations; the driver solves a system as wide as the features.
    """
    import numpy as np

    names = [*features, "_one"]
    rows = train.select(F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in features], F.lit(1.0).alias("_one"))
    w = None
    for _ in range(rounds):
        rest = F.lit(0.0) if w is None else F.col("_y") - sum((F.lit(float(a)) * F.col(c) for a, c in zip(w, names, strict=True)), F.lit(0.0))
        weight = F.lit(1.0) if w is None else F.when(rest >= 0, F.lit(q)).otherwise(F.lit(1 - q)) / F.greatest(F.abs(rest), F.lit(least))
        sums = [F.sum(weight * F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]] + [F.sum(weight * F.col(a) * F.col("_y")) for a in names]
        found = rows.agg(*sums).first()
        if found[0] is None:
            return [0.0] * len(names)
        left, k = np.zeros((len(names),) * 2), 0
        for i in range(len(names)):
            for j in range(i, len(names)):
                left[i, j] = left[j, i] = found[k]
                k += 1
        w = np.linalg.lstsq(left, np.array(found[k:], float), rcond=None)[0]
    return [float(a) for a in w]


def cross_validate(rows: DataFrame, fold: str, pipelines: dict[str, Pipeline], label: str) -> DataFrame:
    """(model, fold, rmse, mae, r2), each fold held out in turn; features that look at labels must be built inside a fold's training rows."""
    spark = rows.sparkSession
    found = []
    for k in [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]:  # a handful of folds
        train, test = rows.filter(F.col(fold) != k), rows.filter(F.col(fold) == k)
        for name, pipeline in pipelines.items():
            scored = pipeline.fit(train).transform(test)
            found.append((name, int(k), *(float(RegressionEvaluator(labelCol=label, metricName=m).evaluate(scored)) for m in ("rmse", "mae", "r2"))))
    return spark.createDataFrame(found, "model string, fold int, rmse double, mae double, r2 double")


def grid_search(train: DataFrame, test: DataFrame, label: str, make, grid: list[dict]) -> tuple[dict, float]:
    """The settings of the lowest RMSE on the test rows; make(**settings) gives a pipeline."""
    evaluator = RegressionEvaluator(labelCol=label, metricName="rmse")
    scores = [(float(evaluator.evaluate(make(**g).fit(train).transform(test))), i) for i, g in enumerate(grid)]
    best, i = min(scores)
    return grid[i], best


def seasonal_fold(day, start_month: int = 12):
    """0 to 3: winter, spring, summer, autumn."""
    return F.floor(F.pmod(F.month(day) - start_month, F.lit(12)) / 3).cast("int")


def distinct_misses(rows: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of rows that a lookup doesn't know, once each: what a live model has to score."""
    return rows.select(*keys).distinct().join(lookup.select(*keys).distinct(), list(keys), "left_anti")


def ranked_sample(rows: DataFrame, by: Sequence[str], order: Sequence, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
