"""Temporal windows over events: bursts, anchored and calendar windows, forward horizons, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(38,4)"


def epoch(ts: str):
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def rolling_bursts(events: DataFrame, ts: str = "ts", by: list[str] | None = None, hours: int = 6) -> DataFrame:
    """Per group and non-empty hour h: events from h to h + hours - 1, and the z-score of that sum over all windows of the group
    (population deviation, 0 counts as 1). Only hourly counts enter the windows."""
    by = by or []
    hour = F.floor(epoch(ts) / 3600).cast("long").alias("hour")
    n = events.groupBy(*by, hour).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("hour").rangeBetween(0, hours - 1)
    v = n.withColumn("v", F.sum("n").over(w))
    stats = v.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.sum("n").alias("total"))
    v = v.join(stats, by) if by else v.crossJoin(F.broadcast(stats))
    z = (F.col("v") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return v.select(*by, "hour", "n", "v", "total", z.alias("z"))


def suppressed(candidates: DataFrame, by: list[str], at: str = "hour", span: int = 6) -> DataFrame:
    """Greedy choice in time order: a candidate counts unless it begins within `span` of the last one that counted. One fold over
    a group's sorted candidates; groups are the accepted bursts of one subject, never raw events."""
    rows = candidates.groupBy(*by).agg(F.array_sort(F.collect_list(at)).alias("_all"))
    kept = F.aggregate("_all", F.expr("cast(array() as array<bigint>)"), lambda s, x: F.when((F.size(s) == 0) | (x >= F.element_at(s, -1) + span), F.concat(s, F.array(x.cast("long")))).otherwise(s))
    return rows.select(*by, F.explode(kept).alias(at))


def anchored_count(events: DataFrame, by: str, ts: str = "ts", seconds: int = 72 * 3600, least: int = 3) -> DataFrame:
    """(by, start, n): the window [t, t + seconds] that begins at an event and holds most events; the earliest of equals."""
    e = events.withColumn("_t", epoch(ts))
    w = Window.partitionBy(by).orderBy("_t").rangeBetween(0, seconds)
    n = e.withColumn("n", F.count("*").over(w))
    best = n.groupBy(by).agg(F.max_by(F.struct("_t", "n"), F.struct("n", -F.col("_t"))).alias("x"))
    return best.select(by, F.col("x._t").alias("start"), F.col("x.n").alias("n")).where(F.col("n") >= least)


def best_days(events: DataFrame, by: str, value: str, ts: str = "ts", days: int = 5) -> DataFrame:
    """(by, day, total, n): the run of `days` calendar days, from a day with events, of the largest sum; the earliest of equals."""
    day = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date"))
    d = events.groupBy(by, day.alias("day")).agg(F.sum(F.col(value).cast(MONEY)).alias("s"), F.count("*").alias("c"))
    w = Window.partitionBy(by).orderBy("day").rangeBetween(0, days - 1)
    s = d.select(by, "day", F.sum("s").over(w).alias("total"), F.sum("c").over(w).alias("n"))
    best = s.groupBy(by).agg(F.max_by(F.struct("day", "total", "n"), F.struct("total", -F.col("day"))).alias("x"))
    return best.select(by, F.col("x.day").alias("day"), F.col("x.total").cast("double").alias("total"), F.col("x.n").cast("long").alias("n"))


def onward(first: DataFrame, later: DataFrame, by: str, ts: str = "ts", value: str = "value", seconds: int = 96 * 3600) -> DataFrame:
    """For each row of `first` (by, ts, id): the largest later row of the group within the horizon. The time is cut into
    horizons, so the join is an equi-join on (group, horizon) and a row meets two horizons only."""
    f = first.select(F.col(by).alias("_k"), F.col("id").alias("first_id"), epoch(ts).alias("_t0")).withColumn("_h", F.explode(F.array(F.floor(F.col("_t0") / seconds), F.floor(F.col("_t0") / seconds) + 1)))
    s = later.select(F.col(by).alias("_k2"), F.col("id").alias("next_id"), epoch(ts).alias("_t1"), F.col(value).alias("next_value")).withColumn("_h2", F.floor(F.col("_t1") / seconds))
    j = f.join(s, (F.col("_k") == F.col("_k2")) & (F.col("_h") == F.col("_h2")) & (F.col("_t1") >= F.col("_t0")) & (F.col("_t1") <= F.col("_t0") + seconds) & (F.col("first_id") != F.col("next_id")))
    best = j.groupBy("_k", "first_id").agg(F.max_by(F.struct("next_id", "next_value"), F.struct("next_value", -F.col("next_id"))).alias("x"))
    return best.select(F.col("_k").alias(by), "first_id", F.col("x.next_id").alias("next_id"), F.col("x.next_value").alias("next_value"))


def chains(transfers: DataFrame, least: float = 200_000.0, horizon: int = 96 * 3600, low: float = 0.35, high: float = 1.05, most: int = 5) -> DataFrame:
    """(first_id, stops, hops, first_amount, last_amount, total_s): from each transfer (id, src, dst, amount, ts) of at least `least`,
    the walk that follows the largest next transfer from where the money is, within the horizon and amount bounds. Each hop is
    an equi-join on (account, horizon) and a top-1 by aggregation."""
    t = transfers.select("id", "src", "dst", "amount", epoch("ts").alias("t"))
    walk = t.where(F.col("amount") >= least).select(F.col("id").alias("first_id"), F.concat_ws(">", "src", "dst").alias("stops"), F.col("dst").alias("at"), F.col("amount").alias("first_amount"), F.col("amount").alias("last_amount"), F.col("t").alias("t0"), F.col("t").alias("last_t"), F.lit(1).alias("hops"), F.array("src", "dst").alias("seen"))
    done = walk
    for _ in range(most - 1):
        w = walk.withColumn("h", F.explode(F.array(F.floor(F.col("last_t") / horizon), F.floor(F.col("last_t") / horizon) + 1)))
        n = t.select(F.col("src").alias("at"), F.col("dst").alias("n_dst"), F.col("amount").alias("n_amount"), F.col("t").alias("n_t"), F.col("id").alias("n_id"), F.floor(F.col("t") / horizon).alias("h"))
        j = w.join(n, ["at", "h"]).where((F.col("n_t") > F.col("last_t")) & (F.col("n_t") <= F.col("last_t") + horizon) & F.col("n_amount").between(low * F.col("last_amount"), high * F.col("last_amount")) & ~F.array_contains("seen", F.col("n_dst")))
        best = j.groupBy("first_id").agg(F.max_by(F.struct("stops", "n_dst", "first_amount", "n_amount", "t0", "n_t", "hops", "seen"), F.struct("n_amount", -F.col("n_id"))).alias("x"))
        walk = best.select("first_id", F.concat_ws(">", "x.stops", "x.n_dst").alias("stops"), F.col("x.n_dst").alias("at"), "x.first_amount", F.col("x.n_amount").alias("last_amount"), "x.t0", F.col("x.n_t").alias("last_t"), (F.col("x.hops") + 1).alias("hops"), F.concat("x.seen", F.array("x.n_dst")).alias("seen"))
        done = done.unionByName(walk)
    top = done.groupBy("first_id").agg(F.max_by(F.struct("stops", "hops", "first_amount", "last_amount", "t0", "last_t"), "hops").alias("x"))
    return top.select("first_id", "x.stops", "x.hops", "x.first_amount", "x.last_amount", (F.col("x.last_t") - F.col("x.t0")).alias("total_s"))


def routes(walks: DataFrame, least: int = 3) -> DataFrame:
    """Walks of at least `least` hops by route (runs, total, retained of the run with the largest first leg); a route that is a suffix of a longer one is
    left out: it is the same money seen from a later leg. Suffixes of a kept route are found by an equi-join."""
    r = walks.where(F.col("hops") >= least).groupBy("stops").agg(F.count("*").alias("runs"), F.sum(F.col("first_amount").cast(MONEY)).cast("double").alias("total"), F.max("hops").alias("hops"), F.max_by(F.col("last_amount") / F.col("first_amount"), F.struct("first_amount", "first_id")).alias("retained"))
    stops = F.split("stops", ">")
    parts = r.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size(stops)), lambda i: F.transform(F.sequence(F.lit(1), F.size(stops) - i + 1), lambda n: F.when(n < F.size(stops), F.array_join(F.slice(stops, i, n), ">")))))).alias("stops")).dropna().distinct()
    return r.join(parts, "stops", "left_anti")
