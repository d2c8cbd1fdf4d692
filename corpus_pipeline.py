"""A corpus pipeline: rules, toxicity, near duplicates, repeated passages, packing.

Each stage takes what the one before kept. A stage is (spark, docs, sf_dir) ->
DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import ngram_join, packing, quality_rules, substring_dedup, toxicity
from tessera.llm._dist import checkpoint_dir
from tessera.llm._ship import ship


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the fences of their language and source."""
    return quality_rules.keep(docs)


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not found toxic by a classifier learnt from the labelled ones among them."""
    ship(spark)
    return toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 over five-word shingles."""
    ship(spark)
    return ngram_join.keep_one(docs, size=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 35 words that also start elsewhere, words joined by one space."""
    ship(spark)
    out = substring_dedup.remove_repeats(docs, joined=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality rules", rules), ("toxicity", detoxify), ("n-gram Jaccard join", near_duplicates), ("substring dedup", passages), ("best-fit packing", sequences)]

#: Tokenisers and trained models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; a table between stages goes to the shared checkpoint folder, and from there when the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _delete(spark, f"{folder}/{k - 1}")
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
