"""Token counts by prefix dynamic programming (operator 9).

The counter in wordbpe.py gives the exact number of tokens of every prefix of a
text. A prefix table stores them for every prefix that ends with a chunk of the text (a
run without white space); counts, cuts and budgets are look-ups in it, without
encoding anything again. every_prefix() gives them for every character.

A row stores two arrays of small steps, chunk by chunk: characters and tokens, whose running
sums are the ends of the prefixes and their counts. Parquet packs a step into a few bits.

Cost: one pass over the texts, no shuffle. A worker remembers a bounded number of
chunks, so a frequent word is worked out once; a text is linear in its length.

Defined results: null and empty texts have 0 bytes, 0 tokens and no prefixes; null ids stay null;
repeated rows give a row each; other columns, whatever their names, aren't read; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slackline.llm import storage
from slackline.llm.frames import map_texts, parts, release
from slackline.llm.textstats import utf8
from slackline.llm.wordbpe import prefix_counter

LIMIT = 2048


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *arrays]), kind))


def prefix_table(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, end_steps and token_steps for every row. tokenizer: path of the vocabulary file."""
    steps = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("end_steps", steps), T.StructField("token_steps", steps)])

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = prefix_counter(tokenizer)
        for column in columns:
            made = []
            for part in parts(column):
                texts = part.to_pylist()
                found = [counter.steps(t) for t in texts]
                of = [pa.array([len(utf8(t)) for t in texts], pa.int64()), *(_lists([f[k] for f in found], pa.int32()) for k in (0, 1))]
                made.append(pa.StructArray.from_arrays(of, names=schema.names))
            yield pa.concat_arrays(made)
        release()

    table = F.arrow_udf(run, schema).asNondeterministic()(F.col(f"`{text}`").cast("string"))
    return df.select("doc_id", table.alias("_made")).select("doc_id", "_made.*")


def total(steps: str) -> Column:
    """The running sum of a column of steps at its end: the whole text's."""
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def longest_within(budget: int) -> Column:
    """Of a row of a prefix table: the length in characters of the longest stored prefix of at most ``budget`` tokens."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("best"))

    def step(a, x):
        end, tokens = a["end"] + x["end_steps"], a["tokens"] + x["token_steps"]
        return F.struct(end.alias("end"), tokens.alias("tokens"), F.when(tokens <= budget, end).otherwise(a["best"]).alias("best"))

    return F.aggregate(F.arrays_zip("end_steps", "token_steps"), start, step, lambda a: a["best"])


def token_counts(df: DataFrame, tokenizer: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row, read off the stored prefix table."""
    table = storage.written(prefix_table(df, tokenizer, text), "prefix-table")
    return table.select("doc_id", "n_bytes", total("token_steps").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def every_prefix(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """doc_id and prefix_tokens: the token count of the text's first 0, 1, 2 ... characters."""
    field = T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))

    def start():
        counter = prefix_counter(tokenizer)
        return lambda t: (counter.every_prefix(t),)

    return map_texts(df, text, [field], start, ["doc_id"])
