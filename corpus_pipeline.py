"""A training corpus in stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from propflow.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from propflow.session import materialize


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not scored as toxic, all columns kept.

    Null and empty texts are scored like any other and stay unless scored toxic; repeated rows go or
    stay together; an empty table stays empty; without labels nothing is learned and all stay.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, all columns kept.

    Texts without words and rows without an id stay; rows that share an id stay together.
    """
    return ngram_join.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, all columns kept; null and empty texts and rows without an id stay."""
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents in as many copies as its target asks for, all columns kept.

    The null source is a source; texts without words come once; repeated rows share their copies.
    """
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its region, rack and shard, by its id alone; a null id has a place too."""
    return sharding.assign_shards(docs, sharding.layout(16))


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", one_per_group),
    ("benchmark_decontamination", decontaminated),
    ("mixing_to_targets", mix_sources),
    ("sharding", shard),
]

# Stages train a classifier, align texts and draw by hash: no SQL gives the same rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
