"""Incremental edges and windowed counts over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.edges import accumulate


KEY = ("src", "dst", "rel_type")


def stream_edges(observations: DataFrame, folder: str, checkpoint: str):
    """Keeps one accumulator an edge in the stream's state, keyed by (src, dst, rel_type), and appends only the edges that a micro-batch touches to
    `folder`, a Parquet partition a batch. Rows count whenever they come: sums, bounds and first-wins attributes do not depend on arrival,
    so there is no watermark and nothing is late. A batch that is replayed writes its partition again; current() reads the edges."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return accumulate(observations).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """Each edge as its latest batch has it (up to batch `upto`, if given). What a batch writes is an edge's whole accumulator, so only the latest counts."""
    rows = spark.read.parquet(folder)
    if upto is not None:
        rows = rows.where(F.col("batch") <= upto)
    rest = [c for c in rows.columns if c not in (*KEY, "batch")]
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*KEY, *(F.col(f"last.{c}").alias(c) for c in rest))


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """The current edges as one batch of a new folder, numbered as the latest one, in place of all batches before."""
    last = spark.read.parquet(folder).agg(F.max("batch")).head()[0]
    current(spark, folder).write.mode("overwrite").parquet(f"{into}/batch={last}")


def hourly(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Tumbling hourly counts; rows later than `late` are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sliding(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Six-hour counts each hour: the streaming form of bursts."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "6 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, by: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
