"""A corpus from raw documents to packed training windows, in five stages.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet
and read again as the next stage's documents. All stages but the last return the columns they
were given, other columns than those named below unread and unchanged, whatever their names.

Defined results of every stage: null ids are kept; rows that repeat are rows of their own unless
a stage says otherwise; whole texts are read, however long; an empty table gives an empty one.
A stage's result is read from tables in the shared folder, which stay until the driver ends, or,
in run(), until the result has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slackline.llm import mixing, near_duplicates, packing, personal_data, quality_rules, storage
from slackline.llm.queries import vocabulary
from slackline.session import shipped

#: Five words a shingle and a similarity of 0.8: 40 bands of 5 minima miss such a pair with a chance of 1e-7.
NEAR = near_duplicates.NearParameters(words=5, percent=80, bands=40, rows=5)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and blank texts among them. Equal texts share a verdict."""
    return quality_rules.keep_good(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with near duplicates the one with the smallest id stays, a null id coming last; of rows that repeat
    that id the first. Rows without a word are like no other, and all stay."""
    return near_duplicates.deduplicate(docs, NEAR)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets; n_chars follows the text, null texts stay null."""
    return personal_data.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to shares in proportion to the square root of their rows, in a global random order.
    A null source is a source of its own; rows that share an id get the same number of copies."""
    return mixing.resample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4,096 tokens, with their token ids, so that a window is its pieces in order of
    offset. A null or empty text is the end token alone; every copy of a document is packed by itself."""
    return packing.pack_documents(docs, vocabulary(), with_ids=True)


STAGES = [(f.__name__, shipped(f)) for f in (keep_good, keep_one_of_each_group, mask_personal_data, mix, pack)]

#: Weak supervision, signatures and subset sums aren't expressed in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES:
        place = storage.mark()
        result = stage(spark, docs, sf_dir)
        tables = storage.since(place)
        docs = storage.written(result, f"stage-{name}")
        storage.forget(spark, tables)
    return docs
