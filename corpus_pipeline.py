"""A training-data pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes ``documents`` as its predecessor left them, is written as
Parquet and read again by the next. All but the last return the columns of
``documents``; the last adds each row's shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sceneloom.llm import decontaminate, mixing, quality, sharding, simhash
from sceneloom.llm.common import Scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing_documents(docs, Scratch(spark, "pipeline-quality"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, Scratch(spark, "pipeline-simhash"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, Scratch(spark, "pipeline-mix"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(docs, Scratch(spark, "pipeline-shard"))


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_each),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", shard),
]

#: Word alignment and linking by fingerprints are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = written.keep(stage(spark, docs, sf_dir), name)
    return docs
