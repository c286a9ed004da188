"""Betweenness by frontier tables and closeness by sketches: centralities over shortest paths, as joins.

Edges are (a, b, weight), undirected. Tables are keyed by (source, node) and written a level at a time, so neither the graph nor a source's
search is ever in one task, and a hub's arcs are dealt to several.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edges import both_ways
from .skew import spread_join
from .store import shared_dir, written


@dataclass
class Arcs:
    """Both directions of every edge (u, v, length), with their count by node (u, n)."""

    rows: DataFrame
    degrees: DataFrame
    total: int

    def onward(self, table: DataFrame, node: str = "node") -> DataFrame:
        """The rows of `table` along every arc that leaves their node: with v and length."""
        return spread_join(self.rows, table.withColumnRenamed(node, "u"), "u", self.degrees, self.total, F.xxhash64("v"))


def arcs_of(edges: DataFrame, length=None) -> Arcs:
    """Edges with a null end or from a node to itself are no arcs; parallel ones count once, by their largest weight."""
    own = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("weight").alias("weight"))
    own = own.withColumn("length", F.lit(1.0) if length is None else length)
    rows = written(both_ways(own, "a", "b", "length"), "arcs")
    degrees = written(rows.groupBy("u").agg(F.count("*").alias("n")), "degrees")
    return Arcs(rows, degrees, rows.count())


def pivots(nodes: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """(source): `most` nodes of (id), drawn by a hash of the id and the seed: all if there are no more."""
    return nodes.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most).select(F.col("id").alias("source"))


def pivot_error(nodes: int, sources: int, miss: float = 0.01) -> float:
    """The error that no node's sampled betweenness exceeds but with a chance of `miss` (Hoeffding over all nodes): a source's share of it lies
    between 0 and nodes / (nodes - 1) after scaling. 0 where every node is a source."""
    if sources >= nodes or nodes < 3:
        return 0.0
    return nodes / (nodes - 1) * math.sqrt(math.log(2 * nodes / miss) / (2 * sources))


class Search:
    """Breadth-first search from many sources at once: a Parquet partition (source, node, sigma) a level below `path`; sigma counts the shortest paths."""

    def __init__(self, arcs: Arcs, sources: DataFrame):
        self.arcs, self.spark = arcs, sources.sparkSession
        self.kind = arcs.rows.schema["u"].dataType.simpleString()
        self.path, self.levels = f"{shared_dir(self.spark)}/casegraph/search-{uuid.uuid4().hex}", 0
        self._write(sources.select("source", F.col("source").alias("node"), F.lit(1.0).alias("sigma")), 0)
        while True:
            front = self.level(self.levels)
            new = arcs.onward(front).groupBy("source", F.col("v").alias("node")).agg(F.sum("sigma").alias("sigma"))
            # a neighbour of level h lies in level h - 1, h or h + 1
            seen = front if self.levels == 0 else front.unionAll(self.level(self.levels - 1))
            self._write(new.join(seen.select("source", "node"), ["source", "node"], "left_anti"), self.levels + 1)
            if self.level(self.levels + 1).isEmpty():
                break
            self.levels += 1

    def _write(self, df: DataFrame, level: int) -> None:
        df.write.option("compression", "zstd").parquet(f"{self.path}/level={level}")

    def level(self, k: int) -> DataFrame:
        return self.spark.read.schema(f"source {self.kind}, node {self.kind}, sigma double").parquet(f"{self.path}/level={k}")

    def distances(self) -> DataFrame:
        """(source, node, distance) of every pair that is joined."""
        out = self.level(0).select("source", "node", F.lit(0).alias("distance"))
        for k in range(1, self.levels + 1):
            out = out.unionAll(self.level(k).select("source", "node", F.lit(k)))
        return out

    def dependencies(self) -> DataFrame:
        """(source, node, dependency): the sum over targets of the share of the source's shortest paths to them that pass through the node, from
        the farthest level back: a node hands (1 + its own) / sigma to each neighbour one level nearer."""
        out, below = None, self.level(self.levels).withColumn("dependency", F.lit(0.0))
        for k in range(self.levels - 1, 0, -1):
            handed = self.arcs.onward(below.select("source", "node", ((1 + F.col("dependency")) / F.col("sigma")).alias("share")))
            handed = handed.groupBy("source", F.col("v").alias("node")).agg(F.sum("share").alias("share"))
            got = F.col("sigma") * F.coalesce("share", F.lit(0.0))
            below = written(self.level(k).join(handed, ["source", "node"], "left").select("source", "node", "sigma", got.alias("dependency")), "dependency")
            own = below.select("source", "node", "dependency")
            out = own if out is None else out.unionAll(own)
        return self.level(0).select("source", "node", F.lit(0.0).alias("dependency")).limit(0) if out is None else out


def _weighted(arcs: Arcs, sources: DataFrame) -> DataFrame:
    """dependencies() over paths of least length: distances by relaxation of the nodes that came nearer, then path counts and shares over the arcs that
    lie on shortest paths, a round a hop."""
    state = written(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("d")), "near")
    front = state
    while True:
        found = arcs.onward(front).groupBy("source", F.col("v").alias("node")).agg(F.min(F.col("d") + F.col("length")).alias("x"))
        both = state.join(found, ["source", "node"], "full")
        better = F.col("d").isNull() | (F.col("x") < F.col("d"))
        state = written(both.select("source", "node", F.when(better, F.col("x")).otherwise(F.col("d")).alias("d"), better.alias("moved")), "near")
        front = state.where("moved").drop("moved")
        state = state.drop("moved")
        if front.isEmpty():
            break
    hop = arcs.onward(state).join(state.select("source", F.col("node").alias("v"), F.col("d").alias("e")), ["source", "v"]).where(F.col("d") + F.col("length") == F.col("e"))
    hop = written(hop.select("source", "u", "v"), "hops")

    def gathered(start: DataFrame, tail: str, head: str) -> DataFrame:
        """(source, node, x): what all ways along the hops from tail to head bring of start's x, start left out."""
        step, out = start, None
        while True:
            step = written(hop.join(step.withColumnRenamed("node", tail), ["source", tail]).groupBy("source", F.col(head).alias("node")).agg(F.sum("x").alias("x")), "ways")
            if step.isEmpty():
                return step if out is None else out.groupBy("source", "node").agg(F.sum("x").alias("x"))
            out = step if out is None else out.unionAll(step)

    first = sources.select("source", F.col("source").alias("node"), F.lit(1.0).alias("x"))
    sigma = written(first.unionAll(gathered(first, "u", "v")).withColumnRenamed("x", "sigma"), "sigma")
    back = gathered(sigma.select("source", "node", (1 / F.col("sigma")).alias("x")), "v", "u")
    own = sigma.join(back, ["source", "node"]).where("source <> node")
    return own.select("source", "node", (F.col("sigma") * F.col("x")).alias("dependency"))


def path_centralities(edges: DataFrame, weighted: bool | None = None, small: int = 600, most_pivots: int | None = None) -> DataFrame:
    """(id, betweenness, closeness) of every node. Betweenness is by paths of least 1/weight for up to `small` nodes, else of fewest hops; closeness by
    hops, scaled by the share of nodes reached. Exact with all nodes as sources (nodes x nodes rows); with most_pivots, betweenness is estimated from
    that many sources, within pivot_error(), and closeness by sketches: for graphs whose pairs do not fit. An empty table gives an empty one."""
    arcs = arcs_of(edges)
    nodes = arcs.degrees.select(F.col("u").alias("id"))
    n = nodes.count()
    weighted = n <= small if weighted is None else weighted
    part = most_pivots is not None and most_pivots < n
    sources = written(pivots(nodes, most_pivots) if part else nodes.select(F.col("id").alias("source")), "sources")
    search = Search(arcs, sources) if not (weighted and part) else None
    if weighted:
        dependency = _weighted(arcs_of(edges, 1 / F.greatest(F.col("weight"), F.lit(1e-6))), sources)
    else:
        dependency = search.dependencies()
    scale = (n / most_pivots if part else 1.0) / ((n - 1) * (n - 2) if n > 2 else 1)
    score = dependency.groupBy(F.col("node").alias("id")).agg((F.sum("dependency") * scale).alias("betweenness"))
    if part:
        close = hyperball(edges).select("id", "closeness")
    else:
        reach = search.distances().groupBy(F.col("source").alias("id")).agg((F.count("*") - 1).alias("r"), F.sum("distance").alias("total"))
        close = reach.select("id", F.when(F.col("total") > 0, F.col("r") / F.col("total") * F.col("r") / (n - 1)).otherwise(0.0).alias("closeness"))
    return nodes.join(score, "id", "left").join(close, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), F.coalesce("closeness", F.lit(0.0)).alias("closeness"))


def hyperball(edges: DataFrame, precision: int = 12, most_rounds: int = 1000) -> DataFrame:
    """(id, reached, closeness): each node keeps a HyperLogLog sketch of the nodes within r hops; round r unites it with its neighbours' of round
    r - 1, and the growth of its estimate is the number of nodes at distance r. Ends when no sketch's estimate grows. The relative error of a ball is about
    1.04 / sqrt(2**precision) (0.016 by default); small balls are counted exactly. Rows: a sketch a node, of 2**precision bytes at most."""
    arcs = arcs_of(edges)
    one = F.hll_sketch_agg("u", F.lit(precision))
    state = arcs.degrees.groupBy(F.col("u").alias("id")).agg(one.alias("ball")).select("id", "ball", F.lit(1.0).alias("size"), F.lit(0.0).alias("far"), F.lit(False).alias("grew"))
    state = written(state, "balls")
    n = state.count()
    for r in range(1, most_rounds + 1):
        sent = arcs.onward(state.select("id", "ball"), "id").select(F.col("v").alias("id"), "ball")
        united = sent.unionAll(state.select("id", "ball")).groupBy("id").agg(F.hll_union_agg("ball").alias("now"))
        size = F.greatest(F.col("size"), F.hll_sketch_estimate("now").cast("double"))
        state = state.join(united, "id").select("id", F.col("now").alias("ball"), size.alias("size"), (F.col("far") + r * (size - F.col("size"))).alias("far"), (size > F.col("size")).alias("grew"))
        state = written(state, "balls")
        if state.where("grew").isEmpty():
            break
    reached = F.least(F.col("size"), F.lit(float(n))) - 1
    return state.select("id", F.col("size").alias("reached"), F.when(F.col("far") > 0, reached / F.col("far") * reached / (n - 1)).otherwise(0.0).alias("closeness"))
