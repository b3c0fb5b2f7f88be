"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slackline.llm import additive_search, mixing, near_duplicates, packing, personal_data, quality_ranker, quality_rules, token_counts, toxicity, warc
from slackline.session import shipped


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ranker.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return mixing.mix_sources(docs)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op4_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_search.nearest(_table(spark, sf_dir, "embeddings"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.span_digests(_table(spark, sf_dir, "documents"))


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"), near_duplicates.NearParameters(words=3, percent=85))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"))


def op9_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary())


def op10_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: shipped(f) for f in (op1_quality_ranker, op2_poisson_mixing, op3_warc_revisits, op4_additive_search, op5_personal_data, op6_toxicity_grammar, op7_minhash_components, op8_quality_rules, op9_prefix_token_counts, op10_bin_slack_packing)
}
ORACLES: dict[str, str] = {"op2_poisson_mixing": mixing.ORACLE, "op3_warc_revisits": warc.ORACLE}
