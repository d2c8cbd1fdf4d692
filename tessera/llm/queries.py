"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality_rules, topk_search
from ._ship import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ftrl_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def op3_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op4_naive_bayes_scaled_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import digests

    return digests(_table(spark, sf_dir, "documents"))


def op6_norm_bucketed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import search

    return search(_table(spark, sf_dir, "embeddings"))


def op7_min_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op8_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import verdicts

    return verdicts(_table(spark, sf_dir, "documents"))


def op9_divide_skip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join

    return join(_table(spark, sf_dir, "documents"))


def op10_karmarkar_karp_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ftrl_quality_classifier, op2_token_counts, op3_super_kmer_dedup, op4_naive_bayes_scaled_toxicity, op5_sentencepiece_lattice, op6_norm_bucketed_topk, op7_min_bin_slack_packing, op8_adaptive_quality_rules, op9_divide_skip_join, op10_karmarkar_karp_sharding)}
SQL: dict[str, str] = {"op8_adaptive_quality_rules": quality_rules.oracle(), "op6_norm_bucketed_topk": topk_search.oracle()}
