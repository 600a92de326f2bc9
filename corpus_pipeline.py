"""Corpus preparation: quality rules, near-dedup, decontamination, mixing and sharding.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. A stage's
result is written as Parquet and read again as the next stage's documents.

Null, blank and short texts fail the quality rules, so later stages meet words only; each stage also
stands alone on tables with nulls in any column, very long texts, repeated rows, extra columns with any
names, and no rows at all: rows are judged by text and id, all columns are carried, and an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import decontaminate, mixing, near_dedup, quality_rules, sharding
from quillmill.storage import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps; repeated rows are judged alike."""
    return quality_rules.keep_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate class; of rows with equal id and text, one."""
    return near_dedup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; an empty benchmark keeps all."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one that a budget cuts keeps its first words."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix; equal texts share a shard."""
    return sharding.shard(docs)


STAGES = [("quality", quality), ("dedup", dedup), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: Weighted MinHash and the k-d tree cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
