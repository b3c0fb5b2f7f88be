"""Shared storage for intermediate tables.

Lineage is cut by writing a table in the folder that the cluster names in
``spark.checkpoint.dir``, which the driver and all executors can read, so a
lost executor costs a task retry and never a table.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

_written: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary folder in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="slackline-")
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/slackline/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """As written(), with aggregates over the rows that are taken while they are written."""
    seen = Observation()
    table = written(df.observe(seen, *[m.alias(k) for k, m in measures.items()]), name)
    return table, seen.get


def delete(spark: SparkSession, path: str) -> None:
    """Remove one path, on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def mark() -> int:
    """A place in the list of tables, for tidy()."""
    return len(_written)


def paths_read(df: DataFrame) -> list[str]:
    """The folders that a plan reads, by its leaves; no files are listed."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for k in range(leaves.size()):
        relation = getattr(leaves.apply(k), "relation", None)
        with suppress(Py4JError):  # leaves without files
            found += relation().location().rootPaths().mkString("\n").split("\n") if relation else []
    return found


def tidy(result: DataFrame, place: int) -> DataFrame:
    """The result, after the tables that were written since mark() gave the place and that it isn't read from are removed.

    The tables that it is read from stay as long as the driver: only its caller knows when it has been used."""
    plain = lambda p: p.split(":", 1)[-1].lstrip("/")  # noqa: E731  file:/a and file:///a are the same place
    in_use = {plain(p) for p in paths_read(result)}
    spark = result.sparkSession
    forget(spark, [path for _, path in _written[place:] if plain(path) not in in_use])
    return result


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that nothing reads any more."""
    for path in paths:
        delete(spark, path)
    _written[:] = [x for x in _written if x[1] not in set(paths)]


def since(place: int) -> list[str]:
    """Paths of the tables made after mark() gave the place."""
    return [path for _, path in _written[place:]]


@atexit.register
def release() -> None:
    """Remove every intermediate table of this driver."""
    while _written:
        spark, path = _written.pop()
        try:
            delete(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            return
