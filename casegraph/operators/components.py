"""Connected components of a link table: alternating large and small star, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import spread_join
from .store import dropped, fixed_plans, settled, written

#: Up to so many arcs the minima of a round are broadcast; they are no more than the arcs.
FEW = 200_000
#: Tasks that read or write a table of few arcs, however many partitions a shuffle has: the driver pays for each task.
TASKS = 8


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of `links`; component is the smallest node reachable.

    Links may repeat, point either way or loop; rows with a null end are no links. An empty table gives an empty one.
    Each round maps a neighbourhood to its minimum by a partially aggregated group-by and a join by broadcast or, of more than FEW
    arcs, one that spreads a hub's links, so no hub is ever gathered in one task. Rounds grow with the logarithm of the longest path; a round deletes the tables of the
    one before it.
    """
    e = links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("v < u").distinct()
    edges = written(e, "links")
    n, mark = edges.count(), None
    while True:
        with fixed_plans(edges.sparkSession, 2 * n <= FEW):
            edges = _few(edges, 2 * n)
            both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))  # large star: over all neighbours
            hubs = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
            large = settled(lambda: _with_least(both.where("v > u"), hubs, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
            dropped(edges)
            large = _few(large, 2 * n)
            least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))  # small star: over smaller neighbours
            small = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
            edges = settled(lambda: _few(_with_least(large, least, n).select(F.inline(small)).where("v < u").distinct(), 2 * n), "small")
            dropped(large)
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == mark:
            break
        n, mark = now[0], now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return _few(ends.distinct(), 2 * n)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """`df` of at most `rows` rows; few are dealt to TASKS tasks."""
    return df.coalesce(TASKS) if rows <= FEW else df


def _with_least(arcs: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """The `total` arcs (u, v), each with its hub's minimum m; many of one hub are dealt to several tasks."""
    if total <= FEW:
        return arcs.join(F.broadcast(_few(least.select("u", "m"), total)), "u")
    least = written(least, "least")
    return spread_join(arcs, least.select("u", "m"), "u", least.select("u", "n"), total, F.xxhash64("v"))


def joined(nodes: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(node, component) of components() over `nodes`, such a table, and further `links` (a, b), which are looked at as links between its
    components. Where these join no more than `most` components, their new names are broadcast."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    ends = written(links.where("a <> b").join(a, "a", "left").join(b, "b", "left"), "ends")
    top = settled(lambda: components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))), "top")
    top_of = top.select(F.col("node").alias("component"), F.col("component").alias("least"))
    new = ends.where("of_a is null").select("a").union(ends.where("of_b is null").select("b")).distinct()
    every = nodes.select("node", "component").union(new.select("a", F.col("a")))
    every = every.join(F.broadcast(top_of) if top.count() <= most else top_of, "component", "left")
    return every.select("node", F.coalesce("least", "component").alias("component"))
