"""The table of queries."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.session import shipped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_local: dict[str, str] = {}


def query(sql: str | None = None, days: tuple[str, ...] = ()):
    """Register a function of (spark, folder) under its name, with the same result in SQL. Columns named in ``days`` are dates,
    which both sides give as text, because clients disagree on their type."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(spark, folder).withColumns({c: F.col(c).cast("string") for c in days})

        QUERIES[function.__name__] = shipped(functools.wraps(function)(run if days else function))
        if sql:
            replaced = ", ".join(f'CAST(CAST("{c}" AS DATE) AS VARCHAR) AS "{c}"' for c in days)
            ORACLES[function.__name__] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if days else sql
        return function

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for a query's own tables: under spark.checkpoint.dir, which all machines share; a temporary one in local mode only."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        shared = _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="slackline-scratch-"))
    return f"{shared.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
