"""Relational shapes: top-k, dedupe, pivot, coalescing joins, grouped tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running
from .store import written

MONEY = "decimal(38,4)"


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """Spark turns this rank limit into a group limit before the shuffle, so a hot group ships k rows a task."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, key, order, 1).drop("rank")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with the unpaged total and whether it is complete; limit 0: all."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset)
    rows = rows.limit(limit) if limit else rows
    return rows.crossJoin(F.broadcast(total)).withColumn("complete", F.lit(offset == 0) & (F.lit(limit == 0) | (F.col("total") <= limit)))


def pivot_counts(df: DataFrame, bucket: Column, kind: str, kinds: list[str]) -> DataFrame:
    return df.groupBy(bucket.alias("bucket")).pivot(kind, kinds).count().na.fill(0)


BUCKETS = {
    "month": lambda c: F.date_format(c, "yyyy-MM"), "day": lambda c: F.date_format(c, "yyyy-MM-dd"), "hour": lambda c: F.date_format(c, "HH"), "weekday": lambda c: F.date_format(c, "EEE"),
    "week": lambda c: F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0")),
}


def aggregate_by(df: DataFrame, group: str | Column, metric: str = "count", value: str | None = None, where: Column | None = None, limit: int = 0) -> DataFrame:
    """The grouped tool: count, sum or mean by a column or a time bucket, the largest first, ties by the group."""
    df = df if where is None else df.where(where)
    g = (F.col(group) if isinstance(group, str) else group).alias("grp")
    measure = {"count": lambda: F.count("*").cast("double"), "sum": lambda: F.sum(F.col(value).cast(MONEY)).cast("double"), "mean": lambda: F.avg(F.col(value).cast(MONEY)).cast("double")}[metric]()
    out = df.groupBy(g).agg(measure.alias("value"))
    return out.orderBy(F.desc("value"), "grp").limit(limit) if limit else out


def in_out(transfers: DataFrame, of: str, src: str = "src", dst: str = "dst", amount: str = "amount") -> DataFrame:
    """Money by counterparty for every subject: (subject, counterparty, money_in, money_out, n)."""
    a = F.col(amount).cast(MONEY)
    rows = transfers.select(F.col(src).alias(of), F.col(dst).alias("counterparty"), F.lit(0).cast(MONEY).alias("i"), a.alias("o")).unionAll(transfers.select(F.col(dst), F.col(src), a, F.lit(0).cast(MONEY)))
    return rows.groupBy(of, "counterparty").agg(F.sum("i").cast("double").alias("money_in"), F.sum("o").cast("double").alias("money_out"), F.count("*").alias("n"))


def by_hour(events: DataFrame, by: str, ts: str = "ts") -> DataFrame:
    """Counts for all 24 hours of each subject, zeros included."""
    n = events.groupBy(by, F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    grid = events.select(by).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(n, [by, "hour"], "left").na.fill(0, ["n"])


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns n_<c>: scaled to 0..1; a constant column is 0."""
    bounds = df.agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(bounds))  # one row
    scaled = {f"n_{c}": F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.0) for c in columns}
    return out.withColumns(scaled).drop(*(f"_{k}_{c}" for c in columns for k in ("lo", "hi")))


def robust(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, MAD, mean, population deviation and 90th percentile, exact. Null keys are a group; a group without values has nulls."""
    base = df.groupBy(*by).agg(F.avg(F.col(value).cast(MONEY)).cast("double").alias("mean"), F.stddev_pop(value).alias("sd"))
    middle = written(quantiles(df, by, value, {"median": 0.5, "p90": 0.9}), "quantiles")
    off = beside(df.select(*by, value), middle, by).withColumn(value, F.abs(F.col(value) - F.col("median")))
    return beside(beside(base, middle, by), quantiles(off, by, value, {"mad": 0.5}), by)


def beside(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """Each row with the columns of its group in `table`, which has a group once (nulls equal, null where it has none); without `by`,
    `table` is one row."""
    if not by:
        return rows.crossJoin(F.broadcast(table))
    same = [F.col(b).eqNullSafe(F.col(f"_g_{b}")) for b in by]
    return rows.join(table.withColumnsRenamed({b: f"_g_{b}" for b in by}), same, "left").drop(*(f"_g_{b}" for b in by))


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, names of `shares`): exact percentiles of each group's values that are not null, between two values in proportion.
    Values are counted and the counts cumulated over ranges, so no task sees all values of a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
    upto = written(running(counts, [*by, value], {"_upto": "_k"}), "counts")
    groups = upto.groupBy(*by).agg(F.min(F.col("_upto") - F.col("_k")).alias("_base"), F.max("_upto").alias("_end"))
    at = {name: p * (F.col("_end") - F.col("_base") - 1) for name, p in shares.items()}
    reached = lambda i: F.min(F.when(F.col("_upto") - F.col("_base") > i, F.col(value)))
    found = beside(upto, groups, by).groupBy(*by).agg(
        *(reached(F.floor(x)).alias(f"_lo_{name}") for name, x in at.items()),
        *(reached(F.ceil(x)).alias(f"_hi_{name}") for name, x in at.items()),
        *(F.max(x).alias(f"_at_{name}") for name, x in at.items()),
    )
    low, high, x = (lambda name, k=k: F.col(f"_{k}_{name}") for k in ("lo", "hi", "at"))
    between = lambda n: (F.ceil(x(n)) - x(n)) * low(n) + (x(n) - F.floor(x(n))) * high(n)
    return found.select(*by, *(F.when(low(n) == high(n), low(n)).otherwise(between(n)).cast("double").alias(n) for n in shares))


def column_quantiles(df: DataFrame, shares: dict[str, tuple[str, float]]) -> DataFrame:
    """One row: for each name the percentile of a column, shares[name] = (column, share); null without values."""
    columns, steps = sorted({c for c, _ in shares.values()}), sorted({p for _, p in shares.values()})
    pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns))
    found = quantiles(df.select(F.explode(pairs).alias("x")).select("x.*"), ["c"], "v", {f"q{i}": p for i, p in enumerate(steps)})
    return found.agg(*(F.max(F.when(F.col("c") == c, F.col(f"q{steps.index(p)}"))).alias(name) for name, (c, p) in shares.items()))


def first_known(df: DataFrame, key: Column, variants: list[Column], lookup: DataFrame, at: str, to: str) -> DataFrame:
    """Each row with the first of its key variants that `lookup` (at, to) knows; misses keep null. One join over exploded variants."""
    rows = df.withColumn("_row", key)
    v = rows.select("_row", F.posexplode(F.array(*variants)).alias("_p", "_v")).where("_v is not null")
    hit = v.join(lookup.select(F.col(at).alias("_v"), F.col(to).alias("found")), "_v").groupBy("_row").agg(F.min_by("found", F.struct("_p", "found")).alias("found"))
    return rows.join(hit, "_row", "left").drop("_row")


def ecod(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, score): per column the larger of the two tails' -ln share at the value, over the empirical distribution, summed. The
    distribution is first counted by value and cumulated over ranges, so no task sees all values."""
    out = df.select(key, *columns)
    total = df.agg(F.count("*").alias("_n"))
    for c in columns:
        n = running(df.groupBy(c).agg(F.count("*").alias("_k")), [c], {"_upto": "_k"}).crossJoin(F.broadcast(total))  # one row
        low, high = F.col("_upto") / F.col("_n"), (F.col("_n") - F.col("_upto") + F.col("_k")) / F.col("_n")
        out = out.join(n.select(c, F.greatest(-F.log(low), -F.log(high)).alias(f"_o_{c}")), c)
    return out.select(key, sum((F.col(f"_o_{c}") for c in columns), F.lit(0.0)).alias("score"))
