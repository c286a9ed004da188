"""Merkle manifest of a dataset: a node store by level, proofs by coordinate. DataFrame operations only.

Leaves stand in runs of up to 256 consecutive nodes of one tree. The store has a Parquet partition a level and a row a run; each level is made
by one pass over the rows of the level before, so nodes are shuffled only where 256 runs become one. Proofs are taken from the top down: the
runs of eight levels meet by their coordinates (tree, run), and each run gets the path that its top node has above it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import PART, dealt, numbered, summed
from ..operators.skew import spread_join
from ..operators.store import shared_dir, written

#: Levels of a run: it has 2**LEVELS nodes at most at its lowest level.
LEVELS = 8


def record(values: list[Column]) -> Column:
    """The text of a row: `-` for a null, else the UTF-8 byte count, `:` and the value (numbers in decimal)."""
    text = [v.cast("string") for v in values]
    return F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text))


def leaf(values: list[Column]) -> Column:
    """The digest of a row, lowercase hex."""
    return F.sha2(record(values), 256)


def _parents(nodes: Column) -> Column:
    """The digests above consecutive nodes: two by two, the last alone where their number is odd."""
    pair = lambda i: F.sha2(F.concat(F.get(nodes, (2 * i).cast("int")), F.coalesce(F.get(nodes, (2 * i + 1).cast("int")), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1), pair)


def _runs(nodes: DataFrame, at: str, fields: list[str]) -> DataFrame:
    """(tree, run, fields): 2**LEVELS consecutive nodes a row, each field an array in the order of `at`."""
    run = nodes.withColumn("run", F.shiftright(at, LEVELS)).groupBy("tree", "run").agg(F.array_sort(F.collect_list(F.struct(at, *fields))).alias("all"))
    return run.select("tree", "run", *(F.col(f"all.{f}").alias(f) for f in fields))


@dataclass
class Store:
    """Nodes by level below `path` (tree, run, n, nodes), for trees of up to `height` levels over their leaves. n: the nodes that the
    tree has at that level. members: the runs of the leaves (tree, run, n, nodes and an array for each column that leaves carry)."""

    spark: SparkSession
    path: str
    height: int
    members: DataFrame
    trees: DataFrame
    runs: int

    def spread(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        """Rows of runs joined with a row a tree, where a large tree's rows are dealt to several tasks."""
        return spread_join(rows, table, "tree", self.trees.select("tree", F.col("runs").alias("n")), self.runs, F.xxhash64("run"))

    def level(self, k: int) -> DataFrame:
        return self.members.select("tree", "run", "n", "nodes") if k == 0 else self.spark.read.schema("tree string, run long, n long, nodes array<string>").parquet(f"{self.path}/level={k}")

    def tops(self) -> DataFrame:
        """(tree, top): the last node of each tree."""
        out = None
        for k in range(self.height + 1):
            some = self.level(k).where("n = 1").select("tree", F.element_at("nodes", 1).alias("top"))
            out = some if out is None else out.unionAll(some)
        return out


def build(leaves: DataFrame, keep: tuple[str, ...] = (), name: str = "merkle") -> Store:
    """The store of leaves (tree, pos, nodes: a digest, and `keep`); pos counts the leaves of a tree from 0 without gaps."""
    spark = leaves.sparkSession
    path = f"{shared_dir(spark)}/casegraph/{name}-{uuid.uuid4().hex}"
    runs = written(_runs(leaves, "pos", ["nodes", *keep]), "runs")
    trees = written(runs.groupBy("tree").agg(F.sum(F.size("nodes")).cast("long").alias("n"), F.count("*").alias("runs")), "trees")
    most, total = trees.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("runs"), F.lit(0))).head()
    store = Store(spark, path, max(0, most - 1).bit_length(), runs, trees, total)
    store.members = written(store.spread(runs, trees.select("tree", "n")), "members")
    for k in range(1, store.height + 1):
        up = store.level(k - 1).where("n > 1").select("tree", "run", F.ceil(F.col("n") / 2).alias("n"), _parents(F.col("nodes")).alias("nodes"))
        if k % LEVELS == 0:  # a run is one node by now
            up = up.select("tree", "n", F.col("run").alias("pos"), F.element_at("nodes", 1).alias("nodes"))
            size = up.groupBy("tree", F.shiftright("pos", LEVELS).alias("run")).agg(F.first("n").alias("n"))
            up = _runs(up, "pos", ["nodes"]).join(size, ["tree", "run"]).select("tree", "run", "n", "nodes")
        up.write.option("compression", "zstd").parquet(f"{path}/level={k}")
    return store


def _steps(levels: Column, at: Column) -> Column:
    """The siblings of node `at` of a run upwards: `<` and the digest on its left, `>` and the one on its right, or nothing where it is alone."""

    def step(nodes: Column, k: Column) -> Column:
        i = F.floor(at / F.pow(F.lit(2), k)).cast("int")
        left, right = F.concat(F.lit("<"), F.get(nodes, i - 1)), F.concat(F.lit(">"), F.get(nodes, i + 1))
        return F.when(i % 2 == 1, left).otherwise(F.coalesce(right, F.lit("")))

    return F.transform(levels, step)


def paths(store: Store, above: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(tree, leaf, keep, path, and the columns of `above`) of each leaf: its siblings up to the root. above: (tree, over, ...) has the steps over each tree's top."""
    more = [c for c in above.columns if c not in ("tree", "over")]
    upper = None
    for g in range(max(1, -(-store.height // LEVELS)) - 1, -1, -1):
        low = g * LEVELS
        base = store.members if g == 0 else store.level(low).where("n > 1")
        rest = None
        for k in range(low + 1, min(low + LEVELS, store.height)):
            some = store.level(k).where("n > 1").select("tree", "run", F.lit(k).alias("level"), "nodes")
            rest = some if rest is None else rest.unionAll(some)
        run = store.spread(base, above) if upper is None else _over(store, base, above, upper, more)
        if rest is None:
            run = run.withColumn("levels", F.when(F.col("n") > 1, F.array("nodes")).otherwise(F.array()))
        else:
            rest = rest.groupBy("tree", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "nodes"))), lambda x: x["nodes"]).alias("rest"))
            levels = F.when(F.col("n") > 1, F.concat(F.array("nodes"), F.coalesce("rest", F.array().cast("array<array<string>>")))).otherwise(F.array())
            run = run.join(rest, ["tree", "run"], "left").withColumn("levels", levels)
        own = ["nodes", *(keep if g == 0 else ())]
        each = run.select("tree", "run", "levels", "over", *more, F.posexplode(F.arrays_zip(*own)).alias("i", "one"))
        path = F.concat(_steps(F.col("levels"), F.col("i")), "over").alias("path" if g == 0 else "over")
        if g == 0:
            return each.select("tree", F.col("one.nodes").alias("leaf"), *(F.col(f"one.{c}").alias(c) for c in keep), path, *more)
        upper = written(each.select("tree", (F.shiftleft("run", LEVELS) + F.col("i")).alias("run"), path, *more), "paths")
    raise AssertionError("a store has one group of levels at least")


def _over(store: Store, base: DataFrame, above: DataFrame, upper: DataFrame, more: list[str]) -> DataFrame:
    """The runs of some levels with what stands over them: a node of the group of levels above, or what is over the tree where it has one run."""
    alone = F.col("n") <= 2**LEVELS
    return store.spread(base.where(alone), above).unionByName(base.where(~alone).join(upper.select("tree", "run", "over", *more), ["tree", "run"]))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def up(node: Column, step: Column) -> Column:
        side, other = F.substring(step, 1, 1), F.substring(step, 2, 64)
        return F.sha2(F.when(side == "<", F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(path, start, up)


def siblings(path: Column) -> Column:
    """The digests of a path, as one text."""
    return F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), "")


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """(order, leaf, subroot, root, path, keep) of each row: its digest, those of its tree and of all, and its inclusion proof; folded(leaf, path) is the root.

    A tree holds the rows of one value of `tree` (null is a value), ascending by `order` (nulls first; rows of one id by their digest); the
    trees' tops, by the value as UTF-8 bytes with null first, make the last tree. Two nodes have a parent; a last one alone has one too; a tree of one
    leaf is that leaf. keep: further columns of the row, by name. Nulls, empty and very long texts are values like any other (record()), repeated rows
    are leaves each, an empty table gives an empty one, columns that are not named are not read.
    """
    extra = {f"_keep{i}": (n, c) for i, (n, c) in enumerate((keep or {}).items())}
    key = F.when(F.col(tree).isNull(), "").otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))  # never null, in the same order
    own = docs.select(key.alias("tree"), F.col(order).alias("_id"), leaf([F.col(c) for c in columns]).alias("nodes"), *(c.alias(k) for k, (_, c) in extra.items()))
    own = written(own.withColumns({"_row": F.monotonically_increasing_id(), "_one": F.lit(1).cast("long")}), "leaves")  # texts are read once
    by = ["_id", "nodes", "_row"]
    placed = summed(dealt(own, ["tree"], by), ["tree"], by, {"pos": "_one"}).withColumn("pos", F.col("pos") - 1).drop(PART, "_one", "_row")
    store = build(placed, ("_id", *extra))
    tops = written(store.tops(), "tops")
    roots = build(numbered(tops, ["tree"], "pos").select(F.lit("").alias("tree"), "pos", F.col("top").alias("nodes"), F.col("tree").alias("_of")), ("_of",), "root")
    root = roots.tops().select("tree", F.col("top").alias("root"), F.array().cast("array<string>").alias("over"))  # one row
    above = paths(roots, root, ("_of",)).select(F.col("_of").alias("tree"), F.col("leaf").alias("subroot"), "root", F.col("path").alias("over"))
    out = paths(store, written(above, "above"), ("_id", *extra))
    return out.select(F.col("_id").alias(order), "leaf", "subroot", "root", "path", *(F.col(k).alias(n) for k, (n, _) in extra.items()))
