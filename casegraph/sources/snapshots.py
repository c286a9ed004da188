"""Snapshots of results: one table a kind and version, a manifest that says which is the newest, and a version of the graph that makes
older ones stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "kind string, version long"


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    return spark.createDataFrame([], MANIFEST)


def save(df: DataFrame, root: str, kind: str, version: int) -> None:
    """The result of a kind at a version; one saved before at this version is replaced. The manifest is written after the table, so readers
    see whole snapshots only."""
    df.write.mode("overwrite").parquet(f"{root}/{kind}/version={version}")
    df.sparkSession.createDataFrame([(kind, version)], MANIFEST).write.mode("append").parquet(f"{root}/manifest")


def status(spark: SparkSession, root: str, version: int) -> DataFrame:
    """(kind, version, stale): the newest snapshot of each kind; stale if the graph is at a later version."""
    return _manifest(spark, root).groupBy("kind").agg(F.max("version").alias("version")).withColumn("stale", F.col("version") < version)


def load(spark: SparkSession, root: str, kind: str) -> DataFrame | None:
    """The newest snapshot of a kind; None if there is none."""
    newest = _manifest(spark, root).where(F.col("kind") == kind).agg(F.max("version")).head()[0]  # a row
    return None if newest is None else spark.read.parquet(f"{root}/{kind}/version={newest}")
