"""The corpus pipeline: documents in, sharded training documents out. Each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casegraph.llm import decontam, mixing, neardup, quality, sharding
from casegraph.operators.store import written


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    model = quality.fit(docs, quality.grades(spark.read.parquet(f"{sf_dir}/labels.parquet")), 3)
    return quality.rated(docs, model, select_only=True)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: similarity of 0.8 or more over five-word shingles."""
    return neardup.deduplicated(docs, k=5, least=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by source, language and topic."""
    return mixing.mixed(docs, select_only=True)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contiguous shards of near equal bytes."""
    return sharding.sharded(docs, 8)


STAGES = [("quality", rate), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
