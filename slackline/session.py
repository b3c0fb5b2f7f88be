"""Sessions, and the package on their executors."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Bytes of rows that go to Python at a time. Spark's own limit of 64 MB, held on both sides by every core, is much of a small executor.
BATCH_BYTES, SPARKS_BATCH_BYTES = 4 << 20, 64 << 20
_shipped: set[str] = set()


def local_session(cores: str | int = "*", partitions: int = 8, **settings: str) -> SparkSession:
    """A session on this machine, in UTC, with adaptive execution."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("slackline")
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    }
    for key, value in {**conf, **settings}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once an application, and keep batches small unless the session says how large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).removesuffix("b")) == SPARKS_BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="slackline-")) / "slackline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, f"slackline/{source.relative_to(PACKAGE)}")
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def shipped(function: Callable) -> Callable:
    """The function, whose first argument is a session, after ship()."""

    @functools.wraps(function)
    def call(spark: SparkSession, *args):
        ship(spark)
        return function(spark, *args)

    return call
