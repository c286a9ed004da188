"""Blocks and cut nodes of a graph, and from these what the removal of each node would break, for all nodes at once.

A breadth-first forest is numbered in preorder; the lowest and highest number that a subtree reaches beside the tree tell which tree edges lie on a
common cycle. Tree edges that do make a block, as a component of links between their lower ends. Every step is a join or an aggregate a level of the forest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .centrality import Arcs, arcs_of
from .components import components
from .prefix import dealt, summed
from .skew import spread_join
from .store import written


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _levels(arcs: Arcs) -> list[DataFrame]:
    """(node, parent, root) a level: roots are the smallest nodes of their components, a parent is the smallest neighbour one level up."""
    found = components(arcs.rows.select(F.col("u").alias("a"), F.col("v").alias("b")))
    root = found.where("node = component").select("node", F.lit(None).cast(found.schema["node"].dataType).alias("parent"), F.col("node").alias("root"))
    levels = [written(root, "forest")]
    while True:
        new = arcs.onward(levels[-1].select("node", "root")).groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"), F.min("root").alias("root"))
        seen = _union([x.select("node") for x in levels[-2:]])
        new = written(new.join(seen, "node", "left_anti"), "forest")
        if new.isEmpty():
            return levels
        levels.append(new)


def forest(edges: DataFrame) -> tuple[DataFrame, DataFrame, Callable[[DataFrame, DataFrame], DataFrame]]:
    """(node, parent, root, size, pre, low, high): size of the subtree, number in preorder within the component, and the least and largest number
    that the subtree has or reaches by an edge outside the tree; then the arcs outside the tree (u, other, pre and size of u, there: of the
    other end), and a join of nodes with a table of their parents that deals a hub's children to several tasks."""
    arcs = arcs_of(edges)
    levels = _levels(arcs)
    sized, below = [], None
    for level in reversed(levels):
        row = level.withColumn("under", F.lit(0).cast("long")) if below is None else level.join(below.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("under")), "node", "left")
        below = written(row.select("node", "parent", "root", (1 + F.coalesce("under", F.lit(0))).cast("long").alias("size")), "sized")
        sized.insert(0, below)
    kin = dealt(_union(sized[1:]) if len(sized) > 1 else sized[0].limit(0), ["parent"], ["node"], "kin")
    kin = written(summed(kin, ["parent"], ["node"], {"upto": "size"}).select("node", "parent", "root", "size", (F.col("upto") - F.col("size") + 1).alias("after")), "kin")
    fans = written(kin.groupBy("parent").agg(F.count("*").alias("n")), "fans")
    count = kin.count()

    def with_parent(rows: DataFrame, table: DataFrame) -> DataFrame:
        return spread_join(rows, table.withColumnRenamed("node", "parent"), "parent", fans, count, F.xxhash64("node"))

    numbered = [written(sized[0].select("node", "parent", "root", "size", F.lit(0).cast("long").alias("pre")), "pre")]
    for level in levels[1:]:
        here = with_parent(kin.join(level.select("node"), "node"), numbered[-1].select("node", F.col("pre").alias("base")))
        numbered.append(written(here.select("node", "parent", "root", "size", (F.col("base") + F.col("after")).alias("pre")), "pre"))
    nodes = written(_union(numbered), "numbered")
    # what a node reaches beside the tree
    far = spread_join(arcs.rows.select(F.col("u").alias("node"), F.col("v").alias("u")), nodes.select(F.col("node").alias("u"), F.col("pre").alias("there"), F.col("parent").alias("its")), "u", arcs.degrees, arcs.total, F.xxhash64("node"))
    far = spread_join(far.withColumnsRenamed({"u": "other", "node": "u"}), nodes.select(F.col("node").alias("u"), "pre", "parent", "size"), "u", arcs.degrees, arcs.total, F.xxhash64("other"))
    beside = written(far.where(~F.col("other").eqNullSafe(F.col("parent")) & ~F.col("u").eqNullSafe(F.col("its"))), "beside")
    reach = written(beside.groupBy(F.col("u").alias("node")).agg(F.min("there").alias("lo"), F.max("there").alias("hi")), "reach")
    out, below = [], None
    for level in reversed(numbered):
        row = level.join(reach, "node", "left")
        low, high = F.least("pre", "lo"), F.greatest("pre", "hi")
        if below is not None:
            row = row.join(below.groupBy(F.col("parent").alias("node")).agg(F.min("low").alias("l"), F.max("high").alias("h")), "node", "left")
            low, high = F.least("pre", "lo", "l"), F.greatest("pre", "hi", "h")
        below = written(row.select("node", "parent", "root", "size", "pre", low.alias("low"), high.alias("high")), "low")
        out.append(below)
    return written(_union(out), "forest"), beside, with_parent


def blocks(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, parent, root, size, block) of every node, and (node, block, size) of the parts that fall off a node. block: of the tree edge from the parent
    (null for roots); two edges have the same if they lie on a common cycle. A part: the subtrees of the node's children in one block that the
    node's own tree edge is not in; their nodes stay together without the node, and are cut off from all others."""
    nodes, beside, with_parent = forest(edges)
    across = beside.where((F.col("pre") < F.col("there")) & (F.col("pre") + F.col("size") <= F.col("there"))).select(F.col("u").alias("a"), F.col("other").alias("b"))
    above = nodes.select("node", F.col("pre").alias("p"), F.col("size").alias("s"), F.col("parent").isNotNull().alias("inner"))
    tied = with_parent(nodes.where("parent is not null"), above).where(F.col("inner") & ((F.col("low") < F.col("p")) | (F.col("high") >= F.col("p") + F.col("s"))))
    of = components(across.union(tied.select("parent", "node")))
    own = F.when(F.col("parent").isNotNull(), F.coalesce("component", "node")).alias("block")
    nodes = written(nodes.join(of, "node", "left").select("node", "parent", "root", "size", own), "blocks")
    off = with_parent(nodes.where("parent is not null"), nodes.select("node", F.col("block").alias("over"))).where(~F.col("block").eqNullSafe(F.col("over")))
    return nodes, off.groupBy(F.col("parent").alias("node"), "block").agg(F.sum("size").alias("size"))


def cut_nodes(edges: DataFrame) -> DataFrame:
    """(id, component, members, parts, pairs, left, isolated) of every node: its component and the nodes in it, the number of parts that the
    component falls into without the node, the pairs of nodes that are joined in it with and without the node, and how many nodes are left alone.
    A node is a cut node if parts is 2 or more."""
    nodes, off = blocks(edges)
    parts = off.groupBy("node").agg(F.count("*").alias("k"), F.sum("size").alias("s"), F.sum(F.col("size") * (F.col("size") - 1) / 2).alias("pairs"), F.count_if(F.col("size") == 1).alias("alone"))
    whole = nodes.where("parent is null").select("root", F.col("size").alias("members"))
    sizes = nodes.groupBy("root").agg(F.count("*").alias("n"))
    of = spread_join(nodes.select("node", "root"), whole, "root", sizes, nodes.count(), F.xxhash64("node")).join(parts, "node", "left")
    rest = F.col("members") - 1 - F.coalesce("s", F.lit(0))  # what stays with the parent
    choose = lambda x: (x * (x - 1) / 2)
    return of.select(
        F.col("node").alias("id"), F.col("root").alias("component"), "members", (F.coalesce("k", F.lit(0)) + (rest > 0).cast("int")).cast("long").alias("parts"), choose(F.col("members")).cast("long").alias("pairs"),
        (F.coalesce("pairs", F.lit(0.0)) + choose(rest)).cast("long").alias("left"), (F.coalesce("alone", F.lit(0)) + (rest == 1).cast("int")).cast("long").alias("isolated"),
    )


def removal_impact(edges: DataFrame, targets: list | None = None, community: DataFrame | None = None) -> DataFrame:
    """For each node (or each of `targets`): components of the graph before and after its removal, joined pairs of its component before and after,
    nodes left alone, and the share of pairs lost. With community (id, community), each node's at most once, also: the share of
    joined pairs that its community loses, the community's components without it, up to 10 of its members that have no tie inside, and the share of the
    community's tie weight that the node holds. Loops, parallel edges and null ends count as in centrality.arcs_of()."""
    cut = written(cut_nodes(edges), "cut")
    total = cut.agg(F.count_distinct("component")).head()[0]
    loss = F.when(F.col("pairs") > 0, 1 - F.col("left") / F.col("pairs")).otherwise(0.0)
    out = cut.select("id", F.lit(total).cast("long").alias("components_before"), (F.lit(total) - 1 + F.col("parts")).cast("long").alias("components_after"), F.col("pairs").alias("pairs_before"), F.col("left").alias("pairs_after"), "isolated", loss.alias("loss"))
    if community is not None:
        out = out.join(_in_community(edges, community), "id", "left")
    return out if targets is None else out.where(F.col("id").isin(targets))


def _in_community(edges: DataFrame, community: DataFrame) -> DataFrame:
    """(id, community, community_loss, community_components_after, isolated_after, flow_share)."""
    of = written(community.select("id", "community").where("id is not null and community is not null"), "of")
    ends = [of.select(F.col("id").alias(k), F.col("community").alias(f"c{k}")) for k in ("a", "b")]
    inside = written(edges.select("a", "b", "weight").where("a <> b").join(ends[0], "a").join(ends[1], "b").where("ca = cb").withColumnRenamed("ca", "community").drop("cb"), "inside")
    cut = written(cut_nodes(inside).join(of, "id"), "cut")
    flow = inside.groupBy("community").agg(F.sum("weight").alias("flow"))
    touch = inside.select(F.explode(F.array("a", "b")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("touch"))
    comps = cut.groupBy("community", "component").agg(F.max("pairs").alias("pairs")).groupBy("community").agg(F.count("*").alias("comps"), F.sum("pairs").alias("all_pairs"))
    lone = of.join(cut.select("id"), "id", "left_anti")  # members without a tie inside
    some = F.slice(F.array_sort(F.collect_list("id")), 1, 11)
    few = lone.withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy("id"))).where("k <= 11").groupBy("community").agg(some.alias("lone"))
    ties = inside.select(F.col("a").alias("x"), F.col("b").alias("y")).union(inside.select("b", "a")).distinct()
    ends1 = ties.groupBy("x").agg(F.count("*").alias("n"), F.min("y").alias("id")).where("n = 1").select("id", "x")  # left alone without their only neighbour
    hangs = ends1.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("x"))).where("k <= 10").groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("hangs"))
    facts = of.groupBy("community").agg(F.count("*").alias("size")).join(comps, "community", "left").join(lone.groupBy("community").agg(F.count("*").alias("alone")), "community", "left").join(flow, "community", "left").join(few, "community", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    every = spread_join(of, facts, "community", facts.select("community", F.col("size").alias("n")), of.count(), F.xxhash64("id")).join(cut.drop("community"), "id", "left").join(touch, "id", "left").join(hangs, "id", "left")
    none = F.array().cast(f"array<{of.schema['id'].dataType.simpleString()}>")
    gone = F.slice(F.array_sort(F.concat(F.array_except(F.coalesce("lone", none), F.array("id")), F.coalesce("hangs", none))), 1, 10)
    after = zero(F.col("comps")) + zero(F.col("alone")) - 1 + zero(F.col("parts"))
    return every.select(
        "id", "community", F.when(F.col("all_pairs") > 0, (zero(F.col("pairs")) - zero(F.col("left"))) / F.col("all_pairs")).otherwise(0.0).alias("community_loss"),
        after.cast("long").alias("community_components_after"), gone.alias("isolated_after"), F.when(F.col("flow") > 0, F.coalesce("touch", F.lit(0.0)) / F.col("flow")).otherwise(0.0).alias("flow_share"),
    )
