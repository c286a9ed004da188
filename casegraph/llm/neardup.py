"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint is the bitwise majority over the XXH64 of its word shingles. Two fingerprints link when at most
three bits differ; then one of their 32-bit halves differs in at most one bit. The anchors of a half are the words of
a covering code: the perfect binary Golay code on 23 bits (covering radius 3) with the other 9 bits uncoded. A
fingerprint is at home at its nearest anchor and is copied to every anchor within covering radius plus threshold
(about 14 per half), so any linked pair meets at the home anchor of either. Comparison is per anchor: an equi-join on
the anchor with the Hamming distance in its condition. Copies of one fingerprint are one row throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import spread_join
from ..operators.store import dropped, fresh_name, settled, written
from ..operators.components import components, joined
from ._words import SPACE, mixed, rolled, sliced

RADIUS = 3
SEED = 42
_NULL = -(1 << 63)
_SPACES = bytes([32, *range(9, 14)])
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in _SPACES else c for c in range(256))


# --- fingerprints ---


def fingerprint(text: str | None, k: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text: A-Z lower-cased, words between ASCII white space, k-word shingles with
    repeats. Fewer than k words make one shingle; none (null, empty, white space only) gives zero."""
    w = [x for x in text.encode().translate(_LOWER).split(b" ") if x] if text else []
    if not w:
        return 0
    shingles = [b" ".join(x) for x in zip(*(w[i:] for i in range(k)))] if len(w) >= k else [b" ".join(w)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 1 << 16):
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[i : i + (1 << 16)]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = 3) -> DataFrame:
    """The columns `keep` and fp, a signed long with the fingerprint's bits, for each row."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), k) for x in b.column(len(keep))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(fp)], names=[*keep, "fp"])

    return docs.select(*keep, F.col(text).cast("string").alias(fresh_name("text", list(keep)))).mapInArrow(run, schema)


# --- anchors ---

_GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainder(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, _GENERATOR << (bit - 11), 0)
    return v


def _errors() -> np.ndarray:
    """Syndrome to the one error of at most three bits that has it."""
    e = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]
    e += [1 << i | 1 << j | 1 << m for i in range(23) for j in range(i) for m in range(j)]
    e = np.array(e, np.int64)
    out = np.full(1 << 11, -1, np.int64)
    out[_remainder(e)] = e
    return out


ERRORS = _errors()


def home(half: np.ndarray) -> np.ndarray:
    """The nearest anchor of 32-bit values: the Golay word nearest to the low 23 bits, with the high bits as they are."""
    low = half & 0x7FFFFF
    return half ^ ERRORS[_remainder(low)]


def anchors(fp: np.ndarray, halves: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor with its half in bit 32, at home?) for all anchors within radius plus one."""
    at, key, own = [], [], []
    for half in range(halves):
        v = (fp.astype(np.int64) >> (32 * half)) & 0xFFFFFFFF
        near = np.stack([home(v), *(home(v ^ (1 << b)) for b in range(32))], axis=1)
        mine = near[:, :1].copy()
        near.sort(axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        i, j = np.nonzero(new)
        at.append(i)
        key.append(near[i, j] | half << 32)
        own.append(near[i, j] == mine[i, 0])
    return np.concatenate(at), np.concatenate(key), np.concatenate(own)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: pairs of different fingerprints of `distinct` (column fp, no repeats) at most `radius` bits apart.
    Right for radius up to 3: then one half differs in at most one bit."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("the anchors cover radii from 0 to 3")
    schema = "anchor long, fp long, own boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 20_000):
                at, key, own = anchors(part := fp[i : i + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[at]), pa.array(own)], names=["anchor", "fp", "own"])

    placed = written(distinct.select("fp").mapInArrow(run, schema), "anchors")
    x = placed.where("own").select("anchor", F.col("fp").alias("x"))
    y = placed.select("anchor", F.col("fp").alias("y"))
    close = x.join(y, (x.anchor == y.anchor) & (x.x < y.y) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius))
    return close.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


# --- similarity above a threshold ---
#
# Texts whose fingerprints link come first, by the anchors, and stay linked if their shingles are similar enough. A radius of three bits holds
# copies that differ in few words of many. The other texts of a shingle similarity of `least` or more are found by a prefix-filtered
# set join of what the fingerprints have not joined yet, which loses none: with all shingles in one order, two such texts share one of their first
# n - ceil(least * n) + 1 shingles, where n is the size of the set. Any order is right; shingles that a sample shows to be common
# come last, so that they are seldom among the first. Lengths and positions bound the overlap further. A group of n copies is not
# compared n * n times: after the fingerprints' links, texts outside the largest component of a shingle are compared with one member of it, in turns, and at last all pairs that share a shingle and are not in one component yet. There, a sketch of the set bounds the difference: its bits are the parities of the shingles of each of
# 512 classes, so two sketches differ in no more bits than the sets in shingles. Of long texts so few classes say nothing: they have a second sketch
# of as many classes as shingles, which candidates have to pass before sets are made. What is left is verified by the exact Jaccard similarity of
# the shingle sets.

SAMPLE_TEXTS = 50_000
COMMON = 50_000
SKETCH = 8
TURNS = 2
TASK_PAIRS = 2_000_000
BROADCAST_TEXTS = 500_000
_LANES = np.uint64(0x0101010101010101)
_BLACK = ~SPACE


def majority(h: np.ndarray, row: np.ndarray, rows: int, width: int) -> np.ndarray:
    """(rows, width) uint64: bitwise majority over width derived hashes of each item. Bits are counted eight at a time in the
    bytes of 64-bit sums, over runs of at most 255 items, which no byte overflows."""
    out = np.zeros((rows, width), np.uint64)
    if not len(h):
        return out
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    runs = -(-n // 255)
    at = np.repeat(np.arange(rows), runs)
    begin = first[at] + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    have = np.flatnonzero(n)
    for k in range(width):
        x = mixed(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
        bits = np.zeros((rows, 8), np.uint8)
        for b in range(8):
            sums = np.add.reduceat(x >> np.uint64(b) & _LANES, begin).view(np.uint8).reshape(-1, 8)
            count = np.zeros((rows, 8), np.int64)
            count[have] = np.add.reduceat(sums.astype(np.int64), (np.cumsum(runs) - runs)[have], axis=0)
            bits |= (2 * count > n[:, None]).astype(np.uint8) << np.uint8(b)
        out[:, k] = bits.view("<u8")[:, 0]
    return out


def shingle_sets(column: pa.Array, k: int) -> list[bytes]:
    """The sorted set of each text's k-word shingle hashes as bytes; fewer words make one shingle, none makes none."""
    out = [b""] * len(column)
    for base, last, w in sliced(column, _BLACK):
        h, ends = w.word_hash(), w.rows_from()
        s, at = rolled(h, w.row, k)
        begin = np.searchsorted(at, ends)
        for r in range(last - base):
            words = h[ends[r] : ends[r + 1]]
            mine = s[begin[r] : begin[r + 1]] if len(words) >= k else rolled(words, np.zeros(len(words), np.int64), len(words))[0] if len(words) else words
            out[base + r] = np.unique(mine).astype("<u8").tobytes()
    return out


def prefixes(sets: list[bytes], least: float, common: np.ndarray) -> list[bytes]:
    """The first shingles of each set as bytes: those not in `common` by hash, then those in it by their place. common: hashes, the rarest
    first."""
    by = np.argsort(common, kind="stable")
    known = common[by]
    out = []
    for x in sets:
        s = np.frombuffer(x, "<u8")
        n = len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1 if len(s) else 0
        if len(known) and n:
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            place = np.where(known[at] == s, by[at], -1)
            s = s[np.argsort(place, kind="stable")]
        out.append(s[:n].tobytes())
    return out


def parities(s: bytes) -> np.ndarray:
    """The sketch of a set, SKETCH longs."""
    n = np.bincount(np.frombuffer(s, "<u8").astype(np.int64) & (64 * SKETCH - 1), minlength=64 * SKETCH)
    return np.packbits((n & 1).astype(np.uint8)).view("<i8")


def wide(s: bytes) -> bytes:
    """The sketch of a set of more shingles than parities() has bits: parities of at least as many classes, a power of two; empty for other sets."""
    n = len(s) // 8
    if n <= 64 * SKETCH:
        return b""
    classes = 1 << (n - 1).bit_length()
    return np.packbits((np.bincount(np.frombuffer(s, "<u8").astype(np.int64) & (classes - 1), minlength=classes) & 1).astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches of wide() differ, at most as many as the sets in shingles; the longer one is folded to the classes of the other."""
    if not x or not y:
        return 0
    n = min(len(x), len(y))
    p, q = (np.bitwise_xor.reduce(np.frombuffer(w, np.uint8).reshape(-1, n), axis=0) for w in (x, y))
    return int(np.bitwise_count(p ^ q).sum())


def common_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """Hashes of shingles that three or more of `texts` (column text) hold, the rarest first; at most COMMON of the commonest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in shingle_sets(b.column(0), k):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(s, "<i8"))], names=["h"])

    counts = written(texts.select("text").mapInArrow(run, "h long").groupBy("h").count().where("count >= 3"), "common")
    total, lowest = 0, None
    for r in counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).collect():  # a row per count
        if (total := total + r["n"]) > COMMON:
            break
        lowest = r["count"]
    if lowest is None:
        dropped(counts)
        return np.zeros(0, np.uint64)
    rows = counts.where(F.col("count") >= lowest).toArrow()
    dropped(counts)
    h, n = rows.column("h").to_numpy(), rows.column("count").to_numpy()
    return h[np.lexsort((h, n))].view(np.uint64)


def shared(prints: DataFrame) -> DataFrame:
    """(key, id, size, pos) of `prints` (id, no repeats; size; prefix): the first shingles that more than one text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for i in range(0, len(ids), 1000):
                parts = [np.frombuffer(x.as_py(), "<i8") for x in b.column(2)[i : i + 1000]]
                n = [len(x) for x in parts]
                pos = np.concatenate([np.arange(x, dtype=np.int32) for x in n])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(np.repeat(ids[i : i + 1000], n)), pa.array(np.repeat(sizes[i : i + 1000], n)), pa.array(pos)], names=["key", "id", "size", "pos"])

    placed = prints.select("id", "size", "prefix").mapInArrow(run, "key long, id long, size int, pos int")
    return placed.join(placed.groupBy("key").count().where("count > 1").select("key"), "key")


def possible(least: float) -> Column:
    """Whether sizes and positions of a shared shingle in x and y let the similarity reach `least`; the first shingle that two similar texts
    share always passes."""
    nx, ny = F.col("x.size"), F.col("y.size")
    most = F.least(nx - F.col("x.pos"), ny - F.col("y.pos"))
    return (F.least(nx, ny) >= least * F.greatest(nx, ny) - 1e-6) & (most * (1 + least) >= least * (nx + ny) - 1e-6)


def anchor_pairs(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: each of `prints` (id, fp) with the smallest id of its fingerprint, and those of fingerprints that link by their anchors."""
    first = written(prints.groupBy("fp").agg(F.min("id").alias("one"), F.count("*").alias("n")), "distinct")
    total = first.agg(F.sum("n")).head()[0] or 0
    same = spread_join(prints, first.select("fp", "one"), "fp", first.select("fp", "n"), total, F.xxhash64("id")).where("id <> one")
    x, y = (first.select(F.col("fp").alias(k), F.col("one").alias(f"one_{k}")) for k in "ab")
    across = links(first).join(x, "a").join(y, "b").select(F.least("one_a", "one_b").alias("a"), F.greatest("one_a", "one_b").alias("b"))
    return same.select(F.col("one").alias("a"), F.col("id").alias("b")).unionByName(across)


def unlike(placed: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the rows of `placed` with their component `of`, of the shingles whose texts are not in one component of `nodes`
    (node, component) yet; counts: (key, n, main) with the number of texts and the largest component of each such shingle."""
    of = placed.join(nodes.withColumnRenamed("node", "id"), "id", "left").withColumn("of", F.coalesce("component", "id")).drop("component")
    mixed_keys = of.groupBy("key").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi").select("key")
    left = written(of.join(mixed_keys, "key"), "mixed")
    count = left.groupBy("key", "of").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "of")).alias("main"))
    return left, count


def near(least: float) -> Column:
    """Whether the sketches of x and y let the similarity reach `least`."""
    apart = sum((F.bit_count(F.col(f"x.q{i}").bitwiseXOR(F.col(f"y.q{i}"))) for i in range(SKETCH)), F.lit(0))
    return apart * (1 + least) <= (1 - least) * (F.col("x.size") + F.col("y.size")) + 1e-6


def alike(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Those of `pairs` (a, b) whose sketches let the similarity reach `least`."""
    both = pairs.join(sketches.alias("x"), F.col("a") == F.col("x.id")).join(sketches.alias("y"), F.col("b") == F.col("y.id"))
    return both.where(near(least)).select("a", "b")


def finer(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Those of `pairs` (a, b) whose wide sketches let the similarity reach `least`. sketches: (id, size, wide)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (1 - least) * b.column(4).to_numpy(zero_copy_only=False) + 1e-6
            bits = np.array([apart(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3), strict=True)], np.int64)
            yield b.select([0, 1]).filter(pa.array(bits * (1 + least) <= most, pa.bool_()))

    both = pairs.join(sketches.alias("x"), F.col("a") == F.col("x.id")).join(sketches.alias("y"), F.col("b") == F.col("y.id"))
    return both.select("a", "b", F.col("x.wide").alias("w1"), F.col("y.wide").alias("w2"), (F.col("x.size") + F.col("y.size")).alias("sizes")).mapInArrow(run, "a long, b long")


def outsider_pairs(placed: DataFrame, nodes: DataFrame, sketches: DataFrame, least: float, turn: int, pairs: DataFrame) -> DataFrame:
    """(a, b), a < b, not in `pairs`: of each shingle, the texts outside its largest component, each with one text of that component, which shingle and
    turn choose: no more pairs than rows, and a text with many shingles meets many members of a group."""
    left, count = unlike(placed, nodes)
    both = left.join(count.select("key", F.col("main.of").alias("main")), "key")
    member = both.where("of = main").groupBy("key").agg(F.min_by(F.struct("id", "size", "pos"), F.struct(F.xxhash64("id", "key", F.lit(turn)), "id")).alias("p")).select("key", "p.*")
    met = both.where("of <> main").alias("x").join(member.alias("y"), "key").where(possible(least))
    new = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    return alike(new, sketches, least)


def other_pairs(placed: DataFrame, nodes: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of `placed` that share a shingle and are not in one component of `nodes` (node, component) yet. For each
    shingle, the texts outside its largest component are compared with all others; where these are many, in several tasks. sketches: (id, size, q0, q1, ...)."""
    left, count = unlike(placed, nodes)
    work = (F.col("n") - F.col("main.n")).cast("double") * F.col("n") / TASK_PAIRS
    count = count.select("key", F.col("main.of").alias("main"), F.least(F.ceil(work), F.col("n")).cast("int").alias("parts"))
    both = left.join(count, "key").join(sketches.drop("size"), "id")
    x = both.where("of <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    y = both.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    once = (F.col("y.of") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    met = x.alias("x").join(y.alias("y"), ["key", "part"]).where((F.col("x.of") != F.col("y.of")) & once & possible(least) & near(least))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The `pairs` (a, b) whose sets (id, s: sorted hashes as bytes) have a Jaccard similarity of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                union = len(np.unique(np.concatenate([p, q]))) if min(len(p), len(q)) >= least * max(len(p), len(q)) else 0
                ok.append(union > 0 and len(p) + len(q) - union >= least * union - 1e-9)
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    x, y = sets.select(F.col("id").alias("a"), F.col("s").alias("s1")), sets.select(F.col("id").alias("b"), F.col("s").alias("s2"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "s1", "s2").mapInArrow(run, "a long, b long")


# --- operators ---


def _integers(docs: DataFrame, doc_id: str) -> None:
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} has to be an integer column")


def similar_clusters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) per row: groups of texts joined by similarity of at least `least`; component_id as in clusters().
    Equal texts are one; null and wordless texts are equal to each other. A null doc_id counts as the smallest id; ids have to be integers
    (TypeError). An empty table gives an empty one; other columns are not read."""
    _integers(docs, doc_id)
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL)).alias("doc_id"), F.unhex(F.md5(F.when(F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.col(text).cast("string")).otherwise(""))).alias("digest"), F.col(text).cast("string").alias("text"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shingle_sets(b.column(2), k)
            size, q = np.array([len(x) // 8 for x in s], np.int32), np.array([parities(x) for x in s], np.int64).reshape(-1, SKETCH)
            fp = np.array([fingerprint(x.as_py(), k) for x in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(prefixes(s, least, common), pa.binary()), pa.array([wide(x) for x in s], pa.binary()), pa.array(fp), *(pa.array(q[:, i].copy()) for i in range(SKETCH))], names=["doc_id", "digest", "size", "prefix", "wide", "fp", *longs])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shingle_sets(b.column(1), k), pa.binary())], names=["id", "s"])

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = written(finer(pairs, texts.select(node, "size", "wide"), least), "finer")
        used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(named, "node").select("node", F.col("id").alias("doc_id"), "digest")
        used = written(used, "used")
        if used.count() <= BROADCAST_TEXTS:
            used = F.broadcast(used)
        s = own.join(used, ["doc_id", "digest"]).select(F.col("node").alias("id"), "text").mapInArrow(sets, "id long, s binary")
        s = written(s.groupBy("id").agg(F.first("s").alias("s")), "sets")  # rows that repeat
        return verified(pairs, s, least)

    spark = docs.sparkSession
    longs = [f"q{i}" for i in range(SKETCH)]
    # the sample only orders the shingles
    part = max(1, docs.count() // SAMPLE_TEXTS)
    common = common_shingles(own.where(F.pmod(F.xxhash64("digest"), F.lit(part)) == 0).dropDuplicates(["digest"]), k)
    prints = written(own.mapInArrow(printed, "doc_id long, digest binary, size int, prefix binary, wide binary, fp long, " + ", ".join(f"{q} long" for q in longs)), "prints")
    rows = written(prints.select("doc_id", "digest"), "rows")
    texts = written(prints.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "prefix", "wide", "fp", *longs))), "distinct")
    dropped(prints)
    first = texts.select("digest", "id", "n")
    node = F.xxhash64("digest").alias("id")
    named = first.select("digest", "id", "n", node.alias("node"))
    sketches = texts.select(node, "size", *longs)
    pairs = settled(lambda: alike(anchor_pairs(texts.where("size > 0").select(node, "fp")), sketches, least), "anchored")
    tested, nodes = [pairs], spark.createDataFrame([], "node long, component long")
    if not pairs.isEmpty():
        links = settled(lambda: similar(pairs), "similar")
        nodes = settled(lambda: components(links), "nodes")
        dropped(links)
    placed = written(shared(texts.select(node, "size", "prefix")), "shared")

    def with_links(nodes: DataFrame, more: DataFrame) -> DataFrame:
        found = settled(lambda: similar(more), "similar")
        if found.isEmpty():
            dropped(found)
            return nodes
        out = settled(lambda: joined(nodes, found, BROADCAST_TEXTS), "nodes")
        dropped(found, nodes)
        return out

    for turn in range(TURNS):  # linear rounds first: what they join is not compared again
        more = settled(lambda: outsider_pairs(placed, nodes, sketches, least, turn, pairs), "outsiders")
        tested.append(more)
        if more.isEmpty():
            break
        pairs, nodes = pairs.union(more), with_links(nodes, more)
    rest = settled(lambda: other_pairs(placed, nodes, sketches, least).join(pairs, ["a", "b"], "left_anti"), "met")
    dropped(placed)
    if not rest.isEmpty():
        nodes = with_links(nodes, rest)
    dropped(*tested, rest)
    linked = nodes.join(named, "node").select("digest", "component", "id")
    smallest = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    of = first.join(linked.join(smallest, "component").select("digest", "component_id"), "digest", "left").select("digest", F.coalesce("component_id", "id").alias("component_id"))
    total = first.agg(F.sum("n")).head()[0] or 0
    return spread_join(rows, of, "digest", first, total, F.xxhash64("doc_id")).select("doc_id", "component_id")


def clusters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) per row: the smallest doc_id reachable over links, its own included.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id are rows of their own
    with that id; a null doc_id takes no part in the minimum, and a group of null ids only has a null component.
    An empty table gives an empty one. Other columns are not read.
    """
    rows = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), k=k), "fingerprints")
    first = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    pairs = links(first, radius)
    nodes = components(pairs)
    linked = nodes.join(first, nodes.node == first.fp).select("node", "component", "first")
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "component").select(F.col("node").alias("fp"), F.col("component_id"))
    of = first.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    total = first.agg(F.sum("n")).head()[0] or 0
    return spread_join(rows, of, "fp", first, total, F.xxhash64("doc_id")).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of `docs` with one document of each group of similar_clusters(): that of the smallest doc_id. Of rows that repeat this
    id one stays. All columns stay as they are; an empty table gives an empty one. Ids have to be integers (TypeError)."""
    _integers(docs, doc_id)
    key, rank = fresh_name("_key", docs.columns), fresh_name("_rank", docs.columns)
    whole = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL))  # one plain key, so that the join's partitioning serves the window
    kept = similar_clusters(docs, doc_id, text, k, least).where("doc_id = component_id").select(F.col("doc_id").alias(key))
    one = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return docs.withColumn(key, whole).join(kept, key, "left_semi").withColumn(rank, one).where(F.col(rank) == 1).drop(key, rank)
