"""Labelled rows for fitting: held-out folds and a bounded, documented sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each class that a model is fitted on, at most.
SAMPLE_PER_CLASS = 6000


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def clean_labels(labels: DataFrame, label: str) -> DataFrame:
    """One row an id: ids whose rows contradict each other, and nulls, are left out."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    return known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).filter("label = _most").drop("_most")


def training_sample(documents: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, label, text) of the allowed rows that come first by hash of the id, at most
    ``per_class`` of each class. allowed: a condition on doc_id, by which held-out rows stay out.

    The chosen ids, no more than 2 * per_class rows of two numbers, are broadcast, so only the
    chosen texts are shuffled. An id that many rows repeat is one row, with the least of its texts.
    """
    rows = clean_labels(labels, label).filter(allowed).withColumn("_h", F.xxhash64("doc_id"))
    chosen = [rows.filter(F.col("label") == k).orderBy("_h", "doc_id").limit(per_class) for k in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).select("doc_id", "label")
    chosen_rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    return chosen_rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
