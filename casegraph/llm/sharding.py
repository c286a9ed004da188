"""Contiguous shards of near equal bytes: global prefix sums from per-partition totals, cut at equal targets. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.store import written


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """`rows` (doc_id, size, text_crc32, tie and any others) with shard and slot. The only shuffle deals whole rows by ranges."""
    order = ["doc_id", "tie", "size", "text_crc32"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "sizes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    totals = totals.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")))
    everything = rows.agg(F.sum("size").alias("all_bytes"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumns({"upto": F.sum("size").over(within), "nth": F.count("*").over(within)})
    placed = placed.join(F.broadcast(totals), "part").crossJoin(F.broadcast(everything))  # one row: the total
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle * (shards / 2) / F.col("all_bytes")))  # as doubles: one law for rows on a cut too
    return placed.withColumns({"shard": shard.cast("int"), "nth": F.col("rows_before") + F.col("nth") - 1})


def _slots(placed: DataFrame, of: DataFrame) -> DataFrame:
    """`placed` with slot; of: rows of the same shards and numbers, without the texts."""
    first = of.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("nth") - F.col("first"))  # a row a shard


def _sized(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("tie")]


def balanced(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row. The rows stand in the order of doc_id (nulls first, rows of one id
    by a hash of the text); a row's size is its UTF-8 bytes plus one (null text: one). Row r goes to the shard in whose
    equal share of all bytes the middle of r falls, so shards are contiguous and each differs from its target by at
    most the largest row. slot counts the rows of a shard from 0. An empty table gives an empty one; a shard may stay
    empty where one row is larger than a target. Rows that repeat a doc_id each have a slot; ids may be of any type that has an
    order; other columns are not read.

    Plan: rows reduced to 40 bytes are dealt by ranges and written with their partition's number; the partitions' totals
    (as many rows as partitions) are summed up in one window and broadcast; running sums are taken per partition. A range holds
    whole keys (id, hash, size, checksum), so copies of one text under one id share a task, other rows of an id do not.
    """
    placed = _placed(docs.select(*_sized(docs, doc_id, text)), shards)
    return _slots(placed, placed).select("doc_id", "size", "text_crc32", "shard", "slot")


def sharded(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with shard and slot, as balanced() gives them, instead of any columns so named: the layout of the final output. The
    row itself is carried through the one order, so each row has the slot that balanced() counts for it, whether ids are null, empty
    or repeated."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    placed = _placed(docs.select(*_sized(docs, doc_id, text), row), shards)
    return _slots(placed, placed.drop("row")).select("row.*", "shard", "slot")
