"""Running sums and numbers over a whole table in a global order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import fresh_name, written


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """`df` with sums[name] = column: the sum of the column over all rows up to this one in the order of the columns `order`
    (ascending, nulls first; they should tell rows apart). Rows are dealt by ranges and written with their part's number; the parts'
    totals are summed in one window (a row a part) and broadcast; sums run within the parts."""
    part, n = fresh_name("_part", df.columns), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ranges")
    before, within = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = {name: fresh_name(f"_{name}", df.columns) for name in sums}
    totals = rows.groupBy(part).agg(*(F.sum(c).alias(base[name]) for name, c in sums.items()))
    totals = totals.select(part, *(F.coalesce(F.sum(b).over(before), F.lit(0)).alias(b) for b in base.values()))
    out = rows.withColumns({name: F.sum(c).over(within) for name, c in sums.items()}).join(F.broadcast(totals), part)
    return out.withColumns({name: F.col(name) + F.col(base[name]) for name in sums}).drop(part, *base.values())


def numbered(df: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """`df` with a gapless number from 0 in the global order."""
    one = fresh_name("_one", df.columns)
    return running(df.withColumn(one, F.lit(1).cast("long")), order, {name: one}).withColumn(name, F.col(name) - 1).drop(one)


PART = "_part"


def dealt(df: DataFrame, group: list[str], order: list[str], name: str = "dealt") -> DataFrame:
    """`df` written in the order of group and order (nulls first; they should tell rows apart), with the number of its range as `_part`: a group may
    stand in many consecutive parts, and only the first group of a part can have begun in an earlier one. `_part` must not be taken."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *group, *order).withColumn(PART, F.spark_partition_id()), name)


def summed(parts: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Rows of dealt() with sums[name] = column: the sum of the column over the rows of the same group up to this one. A window holds the rows of one
    group in one part; what a group has in earlier parts comes from the totals by part and group, of which at most one a part is needed: these few
    rows are broadcast, so a group of any size is never in one task."""
    base, mine = {n: fresh_name(f"_b_{n}", parts.columns) for n in sums}, {g: fresh_name(f"_g_{g}", parts.columns) for g in group}
    within = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(PART, *group).agg(*(F.sum(c).alias(base[n]) for n, c in sums.items()))
    earlier = totals.select(PART, *(F.col(g).alias(m) for g, m in mine.items()), F.count("*").over(before).alias("_earlier"), *(F.sum(b).over(before).alias(b) for b in base.values()))
    earlier = earlier.where("_earlier > 0").drop("_earlier")  # the first group of a part: no more rows than parts
    out = parts.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}).join(F.broadcast(earlier), PART, "left")
    same = F.lit(True)
    for g, m in mine.items():
        same = same & F.col(g).eqNullSafe(F.col(m))
    return out.withColumns({n: F.col(n) + F.when(same, F.coalesce(F.col(b), F.lit(0))).otherwise(0) for n, b in base.items()}).drop(*base.values(), *mine.values())
