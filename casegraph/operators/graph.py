"""Graph algorithms over edge tables (a, b, weight), undirected, a < b. Iterative ones cut lineage in the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centrality import path_centralities as path_centralities
from .components import components
from .edges import both_ways
from .prefix import numbered
from .store import iterate, written


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges, "a", "b", "weight").groupBy("u").agg(F.count("*").alias("degree"), F.sum(F.col("weight").cast("decimal(38,6)")).cast("double").alias("weighted_degree")).withColumnRenamed("u", "id")


def density(edges: DataFrame) -> DataFrame:
    n = both_ways(edges, "a", "b").agg(F.count_distinct("u").alias("nodes"))
    return edges.agg(F.count("*").alias("edges")).crossJoin(n).select("nodes", "edges", F.when(F.col("nodes") > 1, 2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0).alias("density"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank): weighted PageRank of the undirected graph; every node has an edge, so nothing dangles. Fixed `rounds` if
    tolerance is 0, else until the summed change is below tolerance x nodes."""
    arcs = both_ways(edges, "a", "b", "weight")
    strength = arcs.groupBy("u").agg(F.sum("weight").alias("s"))
    arcs = written(arcs.join(strength, "u").select("u", "v", (F.col("weight") / F.col("s")).alias("p")), "arcs")
    n = strength.count()
    if not n:
        return strength.select(F.col("u").alias("id"), F.lit(0.0).alias("rank"))

    def step(state: DataFrame, _: int) -> DataFrame:
        sent = arcs.join(state, arcs.u == state.id).groupBy("v").agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        return sent.select(F.col("v").alias("id"), (F.lit((1 - alpha) / n) + alpha * F.col("got")).alias("rank"))

    def done(a: DataFrame, b: DataFrame) -> bool:
        return tolerance > 0 and a.join(b.withColumnRenamed("rank", "now"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("now")))).head()[0] < tolerance * n

    return iterate(strength.select(F.col("u").alias("id"), F.lit(1.0 / n).alias("rank")), step, rounds, done, every=5, name="rank")


def component_sizes(edges: DataFrame) -> DataFrame:
    c = components(edges)
    return c.groupBy("component").agg(F.count("*").alias("size"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, coefficient): weighted by the geometric mean of a triangle's weights over the largest weight; degree < 2: 0.
    Triangles are closed from the end of lower degree, so a hub's neighbours are never paired with each other."""
    top = edges.agg(F.max("weight").alias("top"))
    e = edges.crossJoin(F.broadcast(top)).select("a", "b", (F.col("weight") / F.col("top")).alias("w"))  # one row: the maximum
    deg = degrees(edges).select("id", "degree")
    d1, d2 = deg.select(F.col("id").alias("a"), F.col("degree").alias("da")), deg.select(F.col("id").alias("b"), F.col("degree").alias("db"))
    e = e.join(d1, "a").join(d2, "b")
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = written(e.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"), "w"), "oriented")
    wedge = o.select("x", F.col("y").alias("y1"), F.col("w").alias("w1")).join(o.select("x", F.col("y").alias("y2"), F.col("w").alias("w2")), "x").where("y1 <> y2")
    tri = wedge.join(o.select(F.col("x").alias("y1"), F.col("y").alias("y2"), F.col("w").alias("w3")), ["y1", "y2"])
    tri = tri.select(F.explode(F.array("x", "y1", "y2")).alias("id"), F.cbrt(F.col("w1") * F.col("w2") * F.col("w3")).alias("s"))
    sums = tri.groupBy("id").agg(F.sum("s").alias("s"))
    return deg.join(sums, "id", "left").select("id", F.when(F.col("degree") < 2, 0.0).otherwise(2 * F.coalesce("s", F.lit(0.0)) / (F.col("degree") * (F.col("degree") - 1))).alias("coefficient"))


def two_hop(edges: DataFrame, most_degree: int | None = None) -> DataFrame:
    """(a, b, common, adamic_adar, jaccard) of non-adjacent pairs with a common neighbour. `most_degree` prunes hubs as middle."""
    arcs = both_ways(edges, "a", "b")
    deg = degrees(edges).select("id", "degree")
    mid = arcs.join(deg.withColumnRenamed("id", "u"), "u")
    if most_degree:
        mid = mid.where(F.col("degree") <= most_degree)
    x, y = mid.select("u", F.col("v").alias("a"), "degree"), mid.select("u", F.col("v").alias("b"))
    pairs = x.join(y, "u").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(1 / F.log("degree")).alias("adamic_adar"))
    pairs = pairs.join(edges.select("a", "b"), ["a", "b"], "left_anti")
    da, db = deg.select(F.col("id").alias("a"), F.col("degree").alias("da")), deg.select(F.col("id").alias("b"), F.col("degree").alias("db"))
    return pairs.join(da, "a").join(db, "b").select("a", "b", "common", "adamic_adar", (F.col("common") / (F.col("da") + F.col("db") - F.col("common"))).alias("jaccard"))


def ego(edges: DataFrame, start: DataFrame, hops: int = 2, most: int | None = None) -> DataFrame:
    """(id, hop): nodes within `hops` of the ids of `start`; per hop at most `most` new nodes, the heaviest ties first."""
    arcs = both_ways(edges, "a", "b", "weight")
    seen = start.select("id", F.lit(0).alias("hop"))
    frontier = seen
    for h in range(1, hops + 1):
        near = arcs.join(frontier.select(F.col("id").alias("u")), "u").groupBy(F.col("v").alias("id")).agg(F.max("weight").alias("w"))
        near = near.join(seen, "id", "left_anti")
        if most:
            near = near.orderBy(F.desc("w"), "id").limit(most)
        frontier = near.select("id", F.lit(h).alias("hop"))
        seen = written(seen.unionAll(frontier), "ego")
        frontier = seen.where(F.col("hop") == h)
    return seen


def pruned_neighbours(edges: DataFrame, start: DataFrame, hops: int = 2, most_degree: int = 120, stop: int = 25_000) -> DataFrame:
    """Ids within hops + 1 rounds of `start`, hubs of more than `most_degree` edges not passed through unless they are a start."""
    arcs, deg = both_ways(edges, "a", "b"), degrees(edges)
    hubs = deg.where(F.col("degree") > most_degree).select("id").join(start.select("id"), "id", "left_anti")
    seen = start.select("id").distinct()
    for _ in range(hops + 1):
        near = arcs.join(seen.withColumnRenamed("id", "u"), "u").select(F.col("v").alias("id")).distinct().join(hubs, "id", "left_anti")
        seen = written(seen.unionAll(near).distinct(), "near")
        if seen.count() > stop:
            break
    return seen


def paths(edges: DataFrame, source, target, k: int = 3, cutoff: int = 6) -> DataFrame:
    """Up to k shortest simple paths between two nodes as (length, path): frontier joins of paths that must still be able to
    reach the target, which bounds the frontier; ties by the path."""
    arcs = both_ways(edges, "a", "b")
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    left = spark.range(1).select(F.lit(target).cast(kind).alias("id"), F.lit(0).alias("left"))
    frontier = left
    for h in range(1, cutoff + 1):  # distance to the target
        near = arcs.join(frontier.select(F.col("id").alias("u")), "u").select(F.col("v").alias("id")).distinct().join(left, "id", "left_anti")
        left = written(left.unionAll(near.select("id", F.lit(h).alias("left"))), "left")
        frontier = left.where(F.col("left") == h)
    open_ = spark.range(1).select(F.array(F.lit(source).cast(kind)).alias("path"))
    out = None
    for h in range(1, cutoff + 1):
        step = open_.withColumn("u", F.element_at("path", -1)).join(arcs, "u").where(~F.array_contains("path", F.col("v")))
        step = step.join(left, F.col("v") == left.id).where(F.col("left") <= cutoff - h).select(F.concat("path", F.array("v")).alias("path"), "left")
        step = written(step, "paths")
        found = step.where("left = 0").select(F.lit(h).alias("length"), F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))
        out = found if out is None else out.unionAll(found)
        open_ = step.where("left > 0").select("path")
        if out.limit(k).count() >= k:
            break
    return out.orderBy("length", "path").limit(k)


def proximity(edges: DataFrame, sources: DataFrame, decay: tuple[float, ...] = (1.0, 0.3, 0.09)) -> DataFrame:
    """(id, hop, source, risk): for each node, over sources (id, score) within len(decay) hops, the largest decay x score; every
    source counts at its fewest hops. Frontiers keep (source, node) at first arrival."""
    arcs = both_ways(edges, "a", "b")
    seen = sources.select(F.col("id").alias("source"), "id", "score", F.lit(0).alias("hop"))
    frontier = seen
    for h in range(1, len(decay) + 1):
        near = frontier.join(arcs, frontier.id == arcs.u).select("source", F.col("v").alias("id"), "score").distinct().join(seen, ["source", "id"], "left_anti")
        seen = written(seen.unionByName(near.withColumn("hop", F.lit(h))), "seen")
        frontier = seen.where(F.col("hop") == h)
    factor = F.element_at(F.array(*map(F.lit, decay)), F.col("hop"))
    at = seen.where("hop > 0").withColumn("risk", factor * F.col("score"))
    return at.groupBy("id").agg(F.max("risk").alias("risk"), F.min("hop").alias("hop"), F.count("*").alias("sources"))


def eigenvector(edges: DataFrame, rounds: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """(id, eigenvector): power iteration of the weighted adjacency plus identity within each component, unit length, times the
    component's share of all nodes; components of fewer than three nodes: 0. All components iterate side by side as joins."""
    arcs = written(both_ways(edges, "a", "b", "weight"), "arcs")
    comp = written(components(edges).select(F.col("node").alias("id"), "component"), "of")
    n = comp.count()
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    comp = comp.join(sizes, "component")

    def unit(x: DataFrame) -> DataFrame:
        norm = x.groupBy("component").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        return x.join(norm, "component").select("id", "component", "size", (F.col("x") / F.col("norm")).alias("x"))

    def step(state: DataFrame, _: int) -> DataFrame:
        got = arcs.join(state.select(F.col("id").alias("v"), "x"), "v").groupBy("u").agg(F.sum(F.col("weight") * F.col("x")).alias("got"))
        return unit(state.join(got, state.id == got.u, "left").select("id", "component", "size", (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("x")))

    def done(a: DataFrame, b: DataFrame) -> bool:
        return a.join(b.select("id", F.col("x").alias("y")), "id").agg(F.coalesce(F.max(F.abs(F.col("x") - F.col("y"))), F.lit(0.0))).head()[0] < tolerance

    big = comp.where("size >= 3").select("id", "component", "size", (1 / F.sqrt("size")).alias("x"))
    state = iterate(big, step, rounds, done, name="eigen")  # a step reads the state twice, so lineage is cut each round
    return comp.select("id").join(state.select("id", (F.abs("x") * F.col("size") / n).alias("e")), "id", "left").select("id", F.coalesce("e", F.lit(0.0)).alias("eigenvector"))


def louvain(edges: DataFrame, resolution: float = 1.0, rounds: int = 10, levels: int = 5, protected: DataFrame | None = None) -> DataFrame:
    """(id, community): modularity by synchronous local moves over joins, then aggregation, until nothing moves. In a round only
    nodes of one parity of a hash move, so neighbours do not swap for ever. Ties go to the smallest community; communities are
    numbered by size, the largest first. `protected` (id): parties that belong to no community; their edges tie nobody together and
    their community is -1."""
    if protected is not None:
        out = protected.select("id").distinct()
        rest = edges.join(out.withColumnRenamed("id", "a"), "a", "left_anti").join(out.withColumnRenamed("id", "b"), "b", "left_anti")
        every = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
        found = louvain(rest, resolution, rounds, levels)
        alone = every.join(found, "id", "left_anti").join(out, "id", "left_anti")  # tied to protected parties only
        last = found.agg(F.coalesce(F.max("community") + 1, F.lit(0))).head()[0]
        alone = numbered(alone, ["id"], "community").select("id", (F.col("community") + last).alias("community"))
        return found.union(alone).union(every.join(out, "id", "left_semi").select("id", F.lit(-1).cast("long")))
    arcs = written(both_ways(edges, "a", "b", "weight"), "arcs")
    total = arcs.agg(F.sum("weight")).head()[0]
    of = written(arcs.select(F.col("u").alias("id")).distinct().withColumn("community", F.col("id")), "of")
    if not total:
        return of.select("id", F.lit(0).cast("long").alias("community"))
    for _ in range(levels):
        strength = written(arcs.groupBy("u").agg(F.sum("weight").alias("k")), "strength")
        state = written(strength.select(F.col("u").alias("id"), F.col("u").alias("c"), "k"), "moves")
        moved_any = False
        for r in range(rounds):
            tot = state.groupBy("c").agg(F.sum("k").alias("tot"))
            toward = arcs.where("u <> v").join(state.select(F.col("id").alias("v"), F.col("c").alias("to")), "v").groupBy(F.col("u").alias("id"), "to").agg(F.sum("weight").alias("w"))
            own = state.select("id", F.col("c").alias("to"), F.lit(0.0).alias("w"))
            gain = toward.unionAll(own).groupBy("id", "to").agg(F.sum("w").alias("w")).join(tot.withColumnRenamed("c", "to"), "to").join(state, "id")
            gain = gain.select("id", "c", "k", "to", (F.col("w") - resolution * F.col("k") * (F.col("tot") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)) / total).alias("g"))
            best = gain.groupBy("id", "c", "k").agg(F.max_by("to", F.struct(F.round("g", 9), F.col("to") == F.col("c"), -F.xxhash64("to") % 1000003)).alias("to"))
            moves = (F.pmod(F.xxhash64("id", F.lit(r // 2)), F.lit(2)) == r % 2)
            new = written(best.select("id", F.when(moves, F.col("to")).otherwise(F.col("c")).alias("c"), "k", (moves & (F.col("to") != F.col("c"))).alias("moved")), "moves")
            changed = new.where("moved").limit(1).count()
            state = new.drop("moved")
            moved_any = moved_any or changed > 0
            if not changed and r % 2:
                break
        if not moved_any:
            break
        to = state.select("id", "c")
        of = written(of.join(to.withColumnRenamed("id", "community"), "community").select("id", F.col("c").alias("community")), "of")
        x, y = to.select(F.col("id").alias("u"), F.col("c").alias("cu")), to.select(F.col("id").alias("v"), F.col("c").alias("cv"))
        arcs = written(arcs.join(x, "u").join(y, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("weight").alias("weight")), "arcs")
    sizes = of.groupBy("community").agg(F.count("*").alias("n"))
    rank = numbered(sizes.withColumn("n", -F.col("n")), ["n", "community"], "number").select("community", "number")
    return of.join(rank, "community").select("id", F.col("number").alias("community"))


def modularity(edges: DataFrame, of: DataFrame) -> float:
    x, y = of.select(F.col("id").alias("a"), F.col("community").alias("ca")), of.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    inside = edges.join(x, "a").join(y, "b").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("w"), F.sum("weight").alias("m")).head()
    k = degrees(edges).join(of, "id").groupBy("community").agg(F.sum("weighted_degree").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).head()[0]
    return inside["w"] / inside["m"] - k / (4 * inside["m"] ** 2)


def clustering_agreement(pairs: DataFrame) -> DataFrame:
    """ARI, NMI and purity of (truth, found), one row an item, from the contingency table."""
    c = pairs.groupBy("truth", "found").agg(F.count("*").cast("double").alias("n"))
    choose = lambda x: x * (x - 1) / 2
    a, b = c.groupBy("truth").agg(F.sum("n").alias("n")), c.groupBy("found").agg(F.sum("n").alias("n"))
    total = c.agg(F.sum("n").alias("items"), F.sum(choose(F.col("n"))).alias("same"))
    h = lambda t, name: t.crossJoin(F.broadcast(total)).agg(F.sum(choose(F.col("n"))).alias(f"c_{name}"), F.sum(-F.col("n") / F.col("items") * F.log(F.col("n") / F.col("items"))).alias(f"h_{name}"))
    pure = c.groupBy("found").agg(F.max("n").alias("m")).agg(F.sum("m").alias("pure"))
    joint = h(c, "ab")
    one = total.crossJoin(h(a, "a")).crossJoin(h(b, "b")).crossJoin(joint).crossJoin(pure)  # one row each
    expected = F.col("c_a") * F.col("c_b") / choose(F.col("items"))
    top = (F.col("c_a") + F.col("c_b")) / 2
    mutual = F.col("h_a") + F.col("h_b") - F.col("h_ab")
    return one.select(
        F.when(top == expected, 1.0).otherwise((F.col("same") - expected) / (top - expected)).alias("ari"), F.when(F.col("h_a") + F.col("h_b") == 0, 1.0).otherwise(2 * mutual / (F.col("h_a") + F.col("h_b"))).alias("nmi"), (F.col("pure") / F.col("items")).alias("purity")
    )


def isolation_scores(points: np.ndarray, trees: int = 300, sample: int = 256, seed: int = 42, others: np.ndarray | None = None) -> np.ndarray:
    """Isolation forest grown on `points`: mean path length over random trees, as the usual score in (0, 1], of `others` or the points
    themselves. A tree depends on the points and the seed only."""
    rng = np.random.default_rng(seed)
    x = points if others is None else others
    n, m = len(points), min(sample, len(points))
    c = lambda k: 2 * (np.log(k - 1) + 0.5772156649015329) - 2 * (k - 1) / k if k > 2 else float(k == 2)
    limit, total = int(np.ceil(np.log2(max(m, 2)))), np.zeros(len(x))
    for _ in range(trees):
        todo = [(rng.choice(n, m, replace=False), np.arange(len(x)), 0)]
        while todo:
            inside, at, depth = todo.pop()
            spread = points[inside].max(0) - points[inside].min(0) if len(inside) > 1 else np.zeros(points.shape[1])
            able = np.flatnonzero(spread > 0)
            if depth >= limit or len(inside) <= 1 or not len(able):
                total[at] += depth + c(len(inside))
                continue
            f = rng.choice(able)
            cut = points[inside, f].min() + rng.random() * spread[f]
            todo += [(inside[points[inside, f] < cut], at[x[at, f] < cut], depth + 1), (inside[points[inside, f] >= cut], at[x[at, f] >= cut], depth + 1)]
    return 2.0 ** (-total / trees / max(c(m), 1e-9))
