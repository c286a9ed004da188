"""Prefix trie of conversations: partial node tables by partition, merged by key in rounds, rolled up along the paths.

A node is known by a hash of the turns that lead to it. Such hashes are made of running sums over a conversation's turns, so a conversation of any
length is never in one task. Each partition combines its own nodes first; tables of 16 partitions are merged at a time until one is left.
Totals over subtrees need no pass a depth: every node is on the path of its smallest member, so what a node adds is carried up that one path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prefix import PART, dealt, summed
from ..operators.skew import spread_join
from ..operators.store import written

#: Partial tries that are merged at a time.
FAN = 16
#: Characters of a list of ids that one row holds.
PIECE = 4096
SUMS = ("s0", "s1", "s2", "s3")
ROOT = "00" * 16


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, i, digest, bytes) of each turn: i counts the turns of a conversation from 0 by `turn` (nulls first; equal ones by role and text), digest
    stands for role and text (null: empty), bytes are those of the text in UTF-8. Rows without a conversation are left out; conv_id has to be an
    integer (TypeError); repeated rows are turns each; other columns are not read."""
    if not isinstance(conversations.schema[conv_id].dataType, T.IntegralType):
        raise TypeError(f"{conv_id} has to be an integer column")
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    own = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), said[0].alias("role"), said[1].alias("text"))
    by = ["turn", "role", "text"]
    own = dealt(own.withColumn("one", F.lit(1).cast("long")), ["conv_id"], by, "turns")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return written(summed(own, ["conv_id"], by, {"i": "one"}).select("conv_id", (F.col("i") - 1).alias("i"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "numbered")


def branched(rows: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """(conv_id, own, i, digest, bytes): turns() of conversations that are rebuilt as branches of others: the first `shared` turns of conversation `base` (own
    0), then the conversation's own turns after its first `shared` (own 1). base and shared are Columns over conv_id; shared is at most `most`."""
    convs = rows.select("conv_id").distinct().select("conv_id", base.alias("base"), shared.alias("shared"))
    heads = rows.where(F.col("i") < most).withColumnRenamed("conv_id", "base")  # at most `most` rows a conversation
    taken = convs.join(heads, "base").where(F.col("i") < F.col("shared")).select("conv_id", F.lit(0).alias("own"), "i", "digest", "bytes")
    return taken.unionByName(rows.where(F.col("i") >= shared).select("conv_id", F.lit(1).alias("own"), "i", "digest", "bytes"))


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth, *sums)))


def _paths(rows: DataFrame, by: list[str]) -> DataFrame:
    """(_part, conv_id, depth, key, parent, bytes) of each turn, in the order of `by` in a conversation. The sums are of four hashes of (turn, place) with 33
    bits each, so two prefixes meet in all of them by chance once in 2**128 or more; parents of the first turns are null."""
    own = summed(dealt(rows.withColumn("one", F.lit(1).cast("long")), ["conv_id"], by, "branches"), ["conv_id"], by, {"depth": "one"})
    hashes = {f"h{s}": F.shiftrightunsigned(F.xxhash64(F.lit(i), "digest", "depth"), 31) for i, s in enumerate(SUMS)}
    own = written(own.select(PART, "conv_id", "depth", "bytes", *(h.alias(n) for n, h in hashes.items())), "hashed")
    own = summed(own, ["conv_id"], ["depth"], {s: f"h{s}" for s in SUMS})
    parent = F.when(F.col("depth") > 1, _key(F.col("depth") - 1, [F.col(s) - F.col(f"h{s}") for s in SUMS]))
    return written(own.select(PART, "conv_id", "depth", _key(F.col("depth"), [F.col(s) for s in SUMS]).alias("key"), parent.alias("parent"), "bytes"), "paths")


def _merged(paths: DataFrame, parts: int) -> DataFrame:
    """(key, parent, depth, bytes, n_convs, conv_id): a trie of each partition's paths, and tries merged FAN at a time."""
    what = ["key", "parent", "depth", "bytes"]
    tries = paths.groupBy(PART, *what).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    while parts > 1:
        parts = -(-parts // FAN)
        tries = tries.withColumn(PART, F.floor(F.col(PART) / FAN)).groupBy(PART, *what).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return written(tries.drop(PART), "nodes")


def _listed(ends: DataFrame) -> DataFrame:
    """(key, sha): SHA-256 of the comma-joined conv_ids of each key of (key, conv_id), ascending. Lists are joined into pieces where their range of
    ids is, whatever their length, and the pieces of a key are hashed as they come in their order; nothing is held but one piece."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, first, ids, size = [], None, None, [], 0
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (k != key or size > PIECE):
                    out.append((key, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    key, first = k, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if len(out) >= 1000:
                yield _batch(out, [pa.binary(), pa.int64(), pa.string()], ["key", "first", "piece"])
                out = []
        if ids:
            out.append((key, first, ",".join(ids)))
        yield _batch(out, [pa.binary(), pa.int64(), pa.string()], ["key", "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, state = [], None, None
        for b in batches:
            for k, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if state:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(piece.encode())
            yield _batch(out, [pa.binary(), pa.string()], ["key", "sha"])
            out = []
        if state:
            yield _batch([(key, state.hexdigest())], [pa.binary(), pa.string()], ["key", "sha"])

    pieces = ends.select("key", "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key binary, first long, piece string")
    return pieces.repartition(n, "key").sortWithinPartitions("key", "first").select("key", "piece").mapInArrow(digest, "key binary, sha string")


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _rolled(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(key, saved, leaves) of each node, in several rows that have to be summed up. A node's smallest member carries what it adds. A conversation carries
    for the last nodes of its path, of which it is the smallest member: for each of these, what it carries from there on; for
    the nodes above, all of it. nodes: with saved and leaf, what a node itself adds."""
    own = dealt(nodes.select("conv_id", "key", "saved", "leaf", (-F.col("depth")).alias("up")), ["conv_id"], ["up"], "chains")
    mine = summed(own, ["conv_id"], ["up"], {"all_saved": "saved", "all_leaves": "leaf"})
    chains = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"), F.min("depth").alias("top"))
    places = paths.select(PART, "conv_id").distinct()  # a conversation of many rows is met part by part
    above = paths.select(PART, "conv_id", "depth", "key").join(chains.join(places, "conv_id"), [PART, "conv_id"]).where(F.col("depth") < F.col("top"))
    above = above.groupBy("key").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    return above.unionByName(mine.select("key", F.col("all_saved").alias("saved"), F.col("all_leaves").alias("leaves")))


def trie(rows: DataFrame, by: list[str], convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node: a distinct sequence of first turns, from
    the empty one at the root. rows: (conv_id, digest, bytes) of each turn, in the order of the columns `by` in a conversation; convs: (conv_id) of all
    conversations, those without a turn included. A node's members are the conversations that begin with it: conv_id is the smallest, n_convs their
    number; (conv_id, depth) names a node, and turn `depth` of conversation conv_id is its last. saved_tokens and n_leaves are sums over the
    subtree, the node included: of (n_convs - 1) x bytes, and of childless nodes. ends_sha256: of the conv_ids that have no further turn.

    No conversations: no nodes. Conversations without turns end at the root. Equal conversations share all nodes.
    """
    paths = _paths(rows, by)
    convs = written(convs.select("conv_id").distinct(), "convs")
    n, least = convs.agg(F.count("*"), F.min("conv_id")).head()
    parts = (paths.agg(F.max(PART)).head()[0] or 0) + 1
    nodes = _merged(paths, parts)
    children = written(nodes.where("depth > 1").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n")), "children")
    value = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = nodes.join(children, "key", "left").select("key", "parent", "depth", "n_convs", "conv_id", value.alias("saved"), F.coalesce("n", F.lit(0)).alias("n_children"))
    nodes = written(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "family")
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("last")).select("conv_id", F.col("last.key").alias("key"))
    root = F.unhex(F.lit(ROOT))
    ends = _listed(last.unionByName(convs.join(last, "conv_id", "left_anti").withColumn("key", root)))
    deep = nodes.where("depth > 1")
    total = deep.count()
    with_parent = spread_join(deep.select("key", "parent"), nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", children.withColumnRenamed("key", "parent"), total, F.xxhash64("key"))
    top = nodes.agg(F.coalesce(F.sum(F.when(F.col("depth") == 1, 1)), F.lit(0)).alias("n_children"), F.greatest(F.lit(1), F.coalesce(F.sum("leaf"), F.lit(0))).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    head = top.select(root.alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(n).cast("long").alias("n_convs"), F.lit(least).cast("long").alias("conv_id"), F.col("n_children").cast("long").alias("n_children"), "leaves", "saved").where(F.lit(n > 0))
    facts = nodes.select("key", "depth", "n_convs", "conv_id", "n_children", F.when(F.col("depth") == 1, least).cast("long").alias("parent_conv_id"))
    every = facts.unionByName(_rolled(nodes, paths), True).unionByName(with_parent.select("key", "parent_conv_id"), True).unionByName(ends, True).unionByName(head, True)
    one = every.groupBy("key").agg(*(F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "sha")), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return one.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, base: Column | None = None, shared: Column | None = None, most: int = 8) -> DataFrame:
    """trie() of conversations (conv_id, turn, role, text), as turns() orders them; rebuilt as branched() says if base and shared are given."""
    rows = turns(conversations)
    convs = rows.select("conv_id").distinct()
    if base is None:
        return trie(rows, ["i"], convs)
    return trie(branched(rows, base, shared, most), ["own", "i"], convs)
