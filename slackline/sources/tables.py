"""Readers, writers and table upkeep on any store that Spark reaches."""

from __future__ import annotations

from datetime import date, timedelta
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

if TYPE_CHECKING:
    import pandas as pd

# The source's German column names and ours.
ISTDATEN_COLUMNS = {
    "BETRIEBSTAG": "operating_day", "FAHRT_BEZEICHNER": "trip_id", "BETREIBER_ID": "operator_id", "BETREIBER_ABK": "operator_abrv",
    "BETREIBER_NAME": "operator_name", "PRODUKT_ID": "product_id", "LINIEN_ID": "line_id", "LINIEN_TEXT": "line_text", "UMLAUF_ID": "circuit_id",
    "VERKEHRSMITTEL_TEXT": "transport", "ZUSATZFAHRT_TF": "unplanned", "FAELLT_AUS_TF": "failed", "BPUIC": "bpuic", "HALTESTELLEN_NAME": "stop_name",
    "ANKUNFTSZEIT": "arr_time", "AN_PROGNOSE": "arr_actual", "AN_PROGNOSE_STATUS": "arr_status", "ABFAHRTSZEIT": "dep_time", "AB_PROGNOSE": "dep_actual",
    "AB_PROGNOSE_STATUS": "dep_status", "DURCHFAHRT_TF": "transit",
}


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A stored table, or only some of its columns."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return table.select(*columns) if columns else table


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """A CSV file with a header; without a schema its types are inferred."""
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_days(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Daily source files, semicolon-separated, as text columns under our names; unknown columns go.
    Days whose file is missing are left out; none at all is an error."""
    if not paths:
        raise ValueError("no days given")
    rows = spark.read.option("header", True).option("sep", ";").option("ignoreMissingFiles", True).csv(paths)
    return rename_source(rows)


def rename_source(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`").alias(ISTDATEN_COLUMNS[c]) for c in rows.columns if c in ISTDATEN_COLUMNS])


def resource_index(pages: DataFrame, pattern: str, text: str = "html") -> DataFrame:
    """(found, page_id) for every match of a pattern's first group in pages, the smallest page of each."""
    hits = pages.select("page_id", F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("found"))
    return hits.groupBy("found").agg(F.min("page_id").alias("page_id"))


def as_declared(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows under a table's schema: its columns in its order and types, missing ones null, others dropped."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def append(rows: DataFrame, path: str, schema: T.StructType) -> None:
    as_declared(rows, schema).write.mode("append").parquet(path)


def write_partitions(rows: DataFrame, path: str, by: list[str], dynamic: bool = True) -> None:
    """Overwrite a partitioned table: only the partitions in ``rows``, or all."""
    mode = "dynamic" if dynamic else "static"
    # the rows of a partition meet before they are written, so that it gets few files; hot ones are split
    rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*by).parquet(path)


def write_single_csv(rows: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_range(spark: SparkSession, folder: str, first: date, last: date) -> DataFrame:
    """Rows of daily folders (day=YYYY-MM-DD) from the first to the last day, both included. Days without a folder are left out;
    none at all is an error. One glob names the days, so they are listed and read in parallel."""
    from pyspark.errors import AnalysisException

    if last < first:
        raise ValueError("no days given")
    days = ",".join((first + timedelta(k)).isoformat() for k in range((last - first).days + 1))
    try:
        return spark.read.option("basePath", folder).parquet(f"{folder}/day={{{days}}}")
    except AnalysisException as e:
        raise ValueError(f"no day from {first} to {last}") from e


def exists(spark: SparkSession, name: str) -> bool:
    """Whether the catalog has a table or view of the name."""
    return spark.catalog.tableExists(name)


def create_once(spark: SparkSession, name: str, rows: DataFrame, force: bool = False, path: str | None = None) -> DataFrame:
    """A saved table that is made when it isn't there, or anew with ``force``; in the warehouse, or at a path."""
    if force:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    if not exists(spark, name):
        writer = rows.write.mode("overwrite")
        (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)


def upload(rows: DataFrame, path: str, schema: T.StructType, batch: int) -> None:
    """A table anew under a declared schema, in files of at most ``batch`` rows, written in parallel."""
    as_declared(rows, schema).write.mode("overwrite").option("maxRecordsPerFile", batch).parquet(path)


def from_local(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    """A driver's small frame as a table, without the columns that are null in every row, whose type nobody knows."""
    return spark.createDataFrame(frame.dropna(axis="columns", how="all"))


def newest(rows: DataFrame, version: str) -> DataFrame:
    """The rows of the newest version. The maximum is a one-row table, so that the scan can be pruned by it."""
    top = rows.agg(F.max(version).alias("_top"))
    return rows.join(top, F.col(version) == F.col("_top")).drop("_top")


def retain(rows: DataFrame, day: str, drop_oldest: int) -> DataFrame:
    """Rows without those of the oldest days. The days are one row each before they are ranked."""
    days = rows.select(F.col(day).alias("_day")).distinct()
    kept = days.withColumn("_n", F.row_number().over(Window.orderBy("_day"))).filter(F.col("_n") > drop_oldest).drop("_n")
    return rows.join(kept, F.col(day) == F.col("_day"), "left_semi")


def region_key(uuids: Column) -> Column:
    """A name for a set of regions that doesn't depend on their order; the empty set is global."""
    sound = F.array_sort(F.array_distinct(F.filter(F.transform(uuids, lambda u: F.trim(u)), lambda u: u != "")))
    return F.when(F.size(sound) > 0, F.concat(F.lit("region_"), F.substring(F.sha1(F.concat_ws(",", sound).cast("binary")), 1, 12))).otherwise(F.lit("global"))


def null_profile(rows: DataFrame) -> DataFrame:
    """(column, nulls, rows) of every column, from one pass."""
    counts = rows.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in rows.columns])
    return counts.unpivot("rows", list(rows.columns), "column", "nulls").select("column", "nulls", "rows")
