"""Mixing sources to target weights by Poisson replication (operator 2).

Every source has a mean repetition rate that brings its rows to its target share.
A document's number of copies is drawn by inverting that Poisson distribution at
a uniform number hashed from the seed and the id, so the draw is repeatable and
needs no random state; copies are exploded and put in a global random order.

Cost: one small aggregation by source and one range shuffle of the drawn rows by
a hash, which is even whatever the sources' sizes are. The table of rates has one
row a source; Spark broadcasts it when its measured size allows, and splits a
skewed join otherwise.

Defined results: a null source is a source of its own; a source without a target
weight gets none of its rows; a null id draws as the text "null"; rows that repeat
an id get the same count each; null or empty texts are copied as any other; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slackline.llm import storage

#: Hexadecimal digits of the hash that make the uniform number: 48 bits.
DIGITS = 12


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the seed and the parts, as text joined by colons."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") / F.lit(float(1 << 4 * DIGITS))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5) -> DataFrame:
    """source and rate, the mean number of copies, so that the mixture has as many rows as ``docs``.

    weights: target shares by source, normalised. Without them a source's share is
    in proportion to its rows to the power ``exponent``.
    """
    rows = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighed = rows.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(exponent)))
    else:
        targets = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "target string, w double")
        weighed = rows.join(targets, rows["source"].eqNullSafe(targets["target"])).select("source", "n", "w")
    total = weighed.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    return weighed.join(total).select("source", (F.col("all_n") * F.col("w") / F.col("all_w") / F.col("n")).alias("rate"))


def poisson_levels(rates: DataFrame) -> DataFrame:
    """source and levels, the cumulative Poisson probabilities of 0, 1, 2 ... as far as doubles can tell them from 1."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    steps = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    factorial = F.sum(F.log(F.greatest(F.col("k"), F.lit(1)).cast("double"))).over(upto)
    mass = F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("factorial"))
    levels = steps.withColumn("factorial", factorial).withColumn("mass", mass).withColumn("level", F.sum("mass").over(upto))
    return levels.groupBy("source").agg(F.sort_array(F.collect_list("level")).alias("levels"))


def _drawn(docs: DataFrame, weights: dict[str, float] | None, exponent: float, seed: int) -> tuple[DataFrame, dict[str, Column]]:
    """The copies in order, under names that can't clash, and the documents' own columns in them; _copies, _copy and _key beside."""
    own = {c: f"_d{i}" for i, c in enumerate(docs.columns)}
    doc_id, source = F.col(own["doc_id"]), F.col(own["source"])
    levels = storage.written(poisson_levels(source_rates(docs.select("source"), weights, exponent)), "mix-levels")
    named = docs.toDF(*own.values())
    drawn = named.join(levels, source.eqNullSafe(F.col("source"))).withColumn("_u", uniform(seed, doc_id))
    drawn = drawn.withColumn("_copies", F.size(F.filter("levels", lambda level: level <= F.col("_u")))).filter("_copies > 0").drop("levels", "source")
    key = F.md5(F.concat_ws(":", F.lit(f"shuffle{seed}"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.col("_copy").cast("string")))
    copied = drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).withColumn("_key", key)
    return copied.orderBy("_key", own["doc_id"]), {c: F.col(o).alias(c) for c, o in own.items()}


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, seed: int = 11) -> DataFrame:
    """The columns of ``docs`` with copies, copy (from 1) and shuffle_key, in the order of that key. Columns of ``docs`` by these names go."""
    drawn, own = _drawn(docs, weights, exponent, seed)
    extra = {"copies": F.col("_copies").alias("copies"), "copy": F.col("_copy").alias("copy"), "shuffle_key": F.col("_key").alias("shuffle_key")}
    return drawn.select(*[c for name, c in own.items() if name not in extra], *extra.values())


def resample(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, seed: int = 11) -> DataFrame:
    """The same rows with the columns of ``docs`` as they were."""
    drawn, own = _drawn(docs, weights, exponent, seed)
    return drawn.select(*own.values())


ORACLE = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
     r AS (SELECT source, sum(n) OVER () * sqrt(n::DOUBLE) / sum(sqrt(n::DOUBLE)) OVER () / n AS rate FROM n),
     k AS (SELECT source, rate, unnest(range(0, 1 + ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k FROM r),
     m AS (SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS level FROM k),
     l AS (SELECT source, list(level) AS levels FROM m GROUP BY source),
     d AS (SELECT doc_id, lang, d.source, n_chars, text,
                  len(list_filter(levels, lambda x: x <= ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE))::INTEGER AS copies
           FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
     c AS (SELECT *, unnest(range(1, 1 + copies))::INTEGER AS copy FROM d WHERE copies > 0)
SELECT doc_id, source, lang, n_chars, text, copies, copy, md5('shuffle11:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key FROM c
"""
