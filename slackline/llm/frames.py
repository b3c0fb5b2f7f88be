"""Small helpers to run a Python function over whole texts in Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes that are held as Python objects at a time.
SLICE_BYTES = 4 << 20


def release() -> None:
    """Give the memory that a task has freed back to the system; a worker lives on and would hold it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def parts(column: pa.Array) -> Iterator[pa.Array]:
    """Parts of a column of about SLICE_BYTES each, one value at least."""
    if column.nbytes <= SLICE_BYTES or len(column) < 2:
        yield column
        return
    half = len(column) // 2
    yield from parts(column.slice(0, half))
    yield from parts(column.slice(half))


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_BYTES of text each, one row at least."""
    at = 0
    for part in parts(batch.column(batch.schema.get_field_index(text))):
        yield batch.slice(at, len(part))
        at += len(part)


def map_texts(df: DataFrame, text: str, fields: list[T.StructField], start: Callable[[], Callable[[str | None], tuple]], keep: Iterable[str]) -> DataFrame:
    """``keep`` columns of ``df`` and, after them, what the function made of each text.

    start() runs once a task and returns the function, which gets a text (or null) and returns a
    tuple of the new columns' values. One row in, one row out. Only the text goes to Python and only
    the new columns come back; the kept ones wait in the JVM, which spills them if it must.
    """
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        function = start()
        for column in columns:
            made = [pa.array([], pa.struct(arrow))]
            for part in parts(column):
                rows = [function(x) for x in part.to_pylist()]
                made.append(pa.StructArray.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], fields=list(arrow)))
            yield pa.concat_arrays(made)
        release()

    of = F.arrow_udf(run, schema).asNondeterministic()  # else a plan may run it once for each column that is asked of it
    kept = [F.col(f"`{c}`") for c in keep]
    return df.select(*kept, of(F.col(f"`{text}`")).alias("_made")).select(*kept, "_made.*")


def internal(df: DataFrame, text: str, carry: list[str]) -> tuple[DataFrame, list[str], str]:
    """The ``carry`` columns and the text under names that can't clash: the frame, the carried columns' names and the text's.
    A text that is carried isn't there twice."""
    own = [f"_c{i}" for i in range(len(carry))]
    columns = [(F.col(f"`{c}`").cast("string") if c == text else F.col(f"`{c}`")).alias(o) for c, o in zip(carry, own, strict=True)]
    if text in carry:
        return df.select(*columns), own, own[carry.index(text)]
    return df.select(*columns, F.col(f"`{text}`").cast("string").alias("_text")), own, "_text"


def long_fields(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]
