"""A training-corpus pipeline over `documents`: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelry.llm import op4_kd_shards, op5_toxicity, op7_minhash_bayes, op8_fair_mix, op10_decontaminate
from parcelry.llm.common import cut, read


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine scores under 0.5; it learns from the labelled rows of docs. Null and empty
    texts hold no insult and stay; repeated rows are judged alike; an empty table stays empty."""
    return op5_toxicity.without_toxic(docs, op5_toxicity.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id, nulls last. Texts without words are no
    duplicates of each other; of rows that repeat an id and text one stays, the least by all columns."""
    return op7_minhash_bayes.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item. Null and empty texts overlap with none; repeated rows go or stay
    together; without benchmark items all stay."""
    return op10_decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one that it takes in part is there as a whole. Texts without words weigh
    nothing and are not taken; null sources are one source; repeated rows are taken row by row."""
    return op8_fair_mix.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with all its columns, and its size, text_crc32, shard and slot, in 8 shards of near equal bytes."""
    return op4_kd_shards.kd_shards(docs, n_shards=8)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can't express the string-kernel machine; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
