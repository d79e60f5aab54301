"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing to
target weights, sharding. Each stage works on what its predecessor kept.

``run`` writes each stage but the last as Parquet under the cluster's shared
folder and reads it again: no stage is computed twice, the next one reads only
the columns it needs, and a lost executor costs tasks of one stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedlake.llm import decontaminate, mixing, quality, sharding, simhash
from feedlake.llm.common import read_table
from feedlake.llm.queries import SHARDS
from feedlake.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines go from the others."""
    return quality.clean_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken per source meet its target; a document is a row for each pass that takes words of it."""
    return mixing.mixed_documents(docs, mixing.cycling_weights)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in shards of equal bytes: adds shard and slot."""
    return sharding.shard_texts(docs, SHARDS)


STAGES = [("quality_rules", quality_stage), ("near_dedup", dedup_stage), ("decontamination", decontamination_stage),
          ("mixing", mixing_stage), ("sharding", sharding_stage)]

#: The stages hash, draw and link: no SQL states them; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
