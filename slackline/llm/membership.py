"""A bounded filter for large semi-joins.

A set of 64-bit keys is hashed to a bitmap of BITS bits, built by a native aggregation and
broadcast: its size is fixed, whatever the number of keys. Rows whose bit isn't set can't
match and needn't be shuffled. Rows whose bit is set may still not match, so an exact join
has to follow. With many more keys than bits it filters little, and costs only its pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MB, broadcast as rows of 4 kB.
BITS = 1 << 26
_ROW = 1 << 15


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """BITS / 32768 rows at most: (_bucket, _bits)."""
    placed = keys.select(_place(key).alias("_p")).select(F.floor(F.col("_p") / _ROW).cast("int").alias("_bucket"), (F.col("_p") % _ROW).alias("_at"))
    return placed.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def likely(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows whose key may be in the bitmap's set."""
    columns = rows.columns
    at = F.col("_p") % _ROW
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumn("_p", _place(key)).withColumn("_bucket", F.floor(F.col("_p") / _ROW).cast("int"))
    hit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return placed.join(F.broadcast(bits), "_bucket").filter(hit).select(*[F.col(f"`{c}`") for c in columns])
