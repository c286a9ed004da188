"""An append-only Merkle log: complete subtrees are stored once, and what changes with the next entry is computed from their peaks.

Node (height, i) covers the leaves from i * 2**height on, 2**height of them. It is stored when the last of these comes, and never changes. The right edge of the
tree, where a node has no sibling and is joined with itself, hangs on the peaks alone: a stored node for each bit of the log's length. Roots are
those of ledger.merkle_root(), but roots and proofs read a number of rows that grows with the logarithm of the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import numbered
from ..operators.store import written
from .ledger import ZERO, digest

SCHEMA = "height int, i long, hash string, upto long"


def _nodes(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    rows = spark.read.schema(SCHEMA).parquet(folder)
    return rows if upto is None else rows.where(F.col("upto") <= upto)


def length(spark: SparkSession, folder: str) -> int:
    """Entries of the log; 0 if there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return _nodes(spark, folder).agg(F.max("upto")).head()[0] or 0
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return 0
        raise


def append(leaves: DataFrame, folder: str, order: list[str]) -> int:
    """Appends (hash, and the columns of `order`) in that order, and returns the new length. The leaves and the subtrees that they complete are written as
    one partition `upto`=length; of what is stored only the peaks are read. An append that was lost half-way is simply done again."""
    spark = leaves.sparkSession
    n = length(spark, folder)
    rows = numbered(leaves, order).select((F.col("i") + n).alias("i"), "hash")
    level = written(rows, "log")
    total = n + level.count()
    if total == n:
        return n
    old = {(r["height"], r["i"]): r["hash"] for r in _read(spark, folder, _peaks(n), n)} if n else {}
    out, height = level.select(F.lit(0).alias("height"), "i", "hash"), 0
    while total >> (height + 1) > n >> (height + 1):
        first = (n >> (height + 1)) * 2  # the left half of the first new pair may be a peak of before
        if (height, first) in old:
            level = level.unionByName(spark.createDataFrame([(first, old[height, first])], "i long, hash string"))
        pair = level.where(F.col("i") < (total >> (height + 1)) * 2).groupBy(F.shiftright("i", 1).alias("i")).agg(F.min_by("hash", "i").alias("x"), F.max_by("hash", "i").alias("y"))
        level = written(pair.select("i", F.sha2(F.concat("x", "y"), 256).alias("hash")), "log")
        height += 1
        out = out.unionByName(level.select(F.lit(height).alias("height"), "i", "hash"))
    out.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/upto={total}")
    return total


def _peaks(n: int) -> list[tuple[int, int]]:
    """(height, i) of the largest complete subtrees side by side: one for each bit of n."""
    return [(h, (n >> h) - 1) for h in range(n.bit_length()) if n >> h & 1]


def _read(spark: SparkSession, folder: str, places: list[tuple[int, int]], upto: int) -> list:
    """The stored nodes at some places: a number of them that grows with the logarithm of the log."""
    if not places:
        return []
    wanted = spark.createDataFrame(places, "height int, i long")
    near = _nodes(spark, folder, upto).where(F.col("i").isin(sorted({i for _, i in places})))
    return near.join(F.broadcast(wanted), ["height", "i"]).collect()


def _edge(n: int, peaks: dict[tuple[int, int], str]) -> tuple[list[str | None], str]:
    """By height the node of the right edge that is no complete subtree (none: null), and the root, of a log of n entries."""
    if not n:
        return [], ZERO
    edge: list[str | None] = [None]
    h = 0
    while (n >> h) + (edge[h] is not None) > 1:
        whole, loose = n >> h, edge[h]
        if (whole + (loose is not None)) % 2:  # the last one is joined with itself
            last = loose if loose is not None else peaks[h, whole - 1]
            edge.append(digest(last + last))
        else:
            edge.append(digest(peaks[h, whole - 1] + loose) if loose is not None else None)
        h += 1
    return edge, edge[h] if edge[h] is not None else peaks[h, 0]


def root(spark: SparkSession, folder: str, n: int | None = None) -> str:
    """The root over the first n entries (default: all); n has to be a length that the log has had after an append, or any smaller number."""
    n = length(spark, folder) if n is None else n
    return _edge(n, _at(spark, folder, _peaks(n)))[1]


def _at(spark: SparkSession, folder: str, places: list[tuple[int, int]]) -> dict[tuple[int, int], str]:
    """Stored nodes at places that the log has by now."""
    return {(r["height"], r["i"]): r["hash"] for r in _read(spark, folder, places, length(spark, folder))}


def inclusion(spark: SparkSession, folder: str, i: int, height: int = 0, n: int | None = None) -> list[tuple[str, str]]:
    """(side, hash) of the siblings of entry i, or of a complete subtree, up to the root over n entries: for ledger.proven()."""
    n = length(spark, folder) if n is None else n
    if not 0 <= i < n >> height:
        raise ValueError(f"the log of {n} entries has no node ({height}, {i})")
    ways, h, at = [], height, i
    top = (n - 1).bit_length()
    while h < top:
        ways.append((h, at))
        h, at = h + 1, at >> 1
    nodes = _at(spark, folder, [*{*((h, at ^ 1) for h, at in ways if at ^ 1 < n >> h), *((h, at) for h, at in ways if at < n >> h), *_peaks(n)}])
    edge, _ = _edge(n, nodes)
    out = []
    for h, at in ways:
        own = nodes[h, at] if at < n >> h else edge[h]
        other = at ^ 1
        sibling = nodes[h, other] if other < n >> h else edge[h] if other == n >> h and edge[h] is not None else own
        out.append(("left" if other < at else "right", sibling))
    return out


def consistency(spark: SparkSession, folder: str, before: int, n: int | None = None) -> list[tuple[int, int, str, list[tuple[str, str]]]]:
    """That the log of n entries goes on from that of `before`: (height, i, hash, way to the new root) of each peak of the old log."""
    n = length(spark, folder) if n is None else n
    known = _at(spark, folder, _peaks(before))
    return [(h, i, known[h, i], inclusion(spark, folder, i, h, n)) for h, i in _peaks(before)]


def consistent(before: int, old_root: str, new_root: str, proof: list) -> bool:
    """Do the old log's peaks give the old root, and does each lead to the new one?"""
    from .ledger import proven

    if [(h, i) for h, i, *_ in proof] != _peaks(before):
        return False
    if _edge(before, {(h, i): x for h, i, x, _ in proof})[1] != old_root:
        return False
    return all(proven(x, way, new_root) for _, _, x, way in proof)
