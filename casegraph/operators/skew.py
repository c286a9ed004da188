"""Joins of rows with a table of unique keys where some keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh_name

#: Keys with more than a 2000th of all rows are hot: there are fewer than 2000 of them, whatever the data.
SHARE = 2000


def spread_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, total: int, spread: Column) -> DataFrame:
    """rows inner join table on `key`, where the rows of a hot key are dealt to several tasks by `spread`, a hash of the row. counts:
    (key, n) of `rows`, with total rows; `table` has each key once, and a hot key's row is copied once per task."""
    salt, n = fresh_name("_salt", [*rows.columns, *table.columns]), fresh_name("_n", [*rows.columns, *table.columns])
    most = max(1, total // SHARE)
    hot = counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias(n))  # fewer than SHARE rows
    left = rows.join(F.broadcast(hot), key, "left").withColumn(salt, F.when(F.col(n).isNotNull(), F.pmod(spread, F.col(n)).cast("int")).otherwise(0)).drop(n)
    right = table.join(F.broadcast(hot), key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))).drop(n)
    return left.join(right, [key, salt]).drop(salt)
