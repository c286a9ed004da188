"""Benchmark decontamination by SimHash of item-sized windows.

For each benchmark item, windows of as many words as the item has get a 64-bit SimHash over their word shingles. Four
16-bit blocks index the items: within Hamming radius 23 some block differs in at most 5 bits, so the lists of a block's
values within 5 bits hold every item in the radius. Candidates are then verified by the exact weighted share of the
item's shingles (a shingle weighs as often as it occurs) that the window holds.

Every window that can pass is formed: one in which fewer of the item's shingles begin than the threshold needs cannot
reach it, all others are fingerprinted, wherever and in whatever order the shingles stand. A window that holds just the
threshold's share lies outside the radius about once in a thousand times, so the windows of a (document, item) pair that
no window in the radius has verified are verified too: the radius loses nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prefix import numbered
from ..operators.store import fresh_name, written
from ._words import rolled, sliced

SHINGLE = 5
RADIUS = 23
BLOCKS = 4
_TABLE_BITS = 20


def simhash(windows: np.ndarray) -> np.ndarray:
    """SimHash of each row of a (windows, shingles) array of hashes: a bit is set where over half the shingles have it."""
    out = np.zeros(len(windows), np.uint64)
    most = max(1, (1 << 24) // (64 * max(1, windows.shape[1])))
    for i in range(0, len(windows), most):
        part = np.ascontiguousarray(windows[i : i + most])
        bits = np.unpackbits(part.view(np.uint8).reshape(*part.shape, 8), axis=2, bitorder="little").sum(1, dtype=np.int32)
        out[i : i + most] = np.packbits(bits * 2 > part.shape[1], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


@dataclass
class Index:
    """What a task needs of a block of items."""

    ids: list[int]
    words: np.ndarray  # words of each item
    shingle: np.ndarray  # shingle length of each item: SHINGLE, or all its words if fewer
    slots: np.ndarray  # shingles of each item
    counts: list[Counter]
    fingerprint: np.ndarray
    keys: dict[int, tuple]  # by shingle length: sorted hashes, first occurrence, item and offset of the occurrences, bitmap
    lists: list[tuple[np.ndarray, np.ndarray]]  # by block: where a value's list begins, items

    def finds(self, fp: np.ndarray, item: int) -> np.ndarray:
        """For which fingerprints `item` is within the radius."""
        at, found = self.near(fp)
        out = np.zeros(len(fp), bool)
        out[at[found == item]] = True
        return out

    def near(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs whose fingerprints are within the radius."""
        pairs = []
        for b, (first, items) in enumerate(self.lists):
            value = (fp >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)
            at, spread = _spread(first[value], first[value + 1])
            item = items[spread]
            ok = np.bitwise_count(fp[at] ^ self.fingerprint[item]) <= RADIUS
            pairs.append(at[ok] * len(self.ids) + item[ok])
        pair = np.unique(np.concatenate(pairs))
        return pair // len(self.ids), pair % len(self.ids)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each range and every position in it."""
    n = last - first
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[at]


def index(items: list[tuple[int, str | None]]) -> Index | None:
    """Items without a word are left out; None if none is left. Items stand in the order of id (null last) and text; ids may be of any
    type that has an order."""
    ids, size, short, slots, counts, prints, occurrences = [], [], [], [], [], [], {}
    known = sorted((x for x in items if x[0] is not None), key=lambda x: (x[0], x[1] or ""))
    for item, text in known + sorted((x for x in items if x[0] is None), key=lambda x: x[1] or ""):
        w = next(iter(sliced(pa.array([text], pa.large_string()), most=1 << 62)))[2]
        if not len(w.start):
            continue
        k = min(SHINGLE, len(w.start))
        h, _ = rolled(w.word_hash(), w.row, k)
        for offset, x in enumerate(h.tolist()):
            occurrences.setdefault(k, []).append((x, len(ids), offset))
        ids.append(item)
        size.append(len(w.start))
        short.append(k)
        slots.append(len(h))
        counts.append(Counter(h.tolist()))
        prints.append(simhash(h[None, :])[0])
    if not ids:
        return None
    keys = {}
    for k, rows in occurrences.items():
        rows.sort()
        h = np.array([r[0] for r in rows], np.uint64)
        unique, first = np.unique(h, return_index=True)
        bitmap = np.zeros(1 << _TABLE_BITS, bool)
        bitmap[unique >> np.uint64(64 - _TABLE_BITS)] = True
        keys[k] = (unique, np.append(first, len(h)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), bitmap)
    fp = np.array(prints, np.uint64)
    masks = np.array([sum(1 << i for i in c) for q in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), q)], np.int64)
    lists = []
    for b in range(BLOCKS):
        value = (fp >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)
        reached = (value[:, None] ^ masks[None, :]).ravel()
        order = np.argsort(reached, kind="stable")
        lists.append((np.searchsorted(reached[order], np.arange(65537)), np.repeat(np.arange(len(fp), dtype=np.int32), len(masks))[order]))
    return Index(ids, np.array(size), np.array(short), np.array(slots), counts, fp, keys, lists)


def matches(column: pa.Array, ix: Index, least: float) -> list[tuple[int, int, float, int]]:
    """(row, item's number in the index, similarity, first word of the best window), one for each row and item."""
    out: list[tuple[int, int, float, int]] = []
    for base, _, w in sliced(column):
        h, ends = w.word_hash(), w.rows_from()
        for k, (unique, first, items, offsets, bitmap) in ix.keys.items():
            s, at = rolled(h, w.row, k)
            hit = np.flatnonzero(bitmap[s >> np.uint64(64 - _TABLE_BITS)])
            if not len(hit):
                continue
            key = np.searchsorted(unique, s[hit])
            hit, key = hit[(ok := unique[np.minimum(key, len(unique) - 1)] == s[hit])], key[ok]
            if not len(hit):
                continue
            which, spread = _spread(first[key], first[key + 1])
            pos, item, offset = at[hit[which]], items[spread], offsets[spread]
            row = w.row[pos]
            n_items = len(ix.ids)
            pair = np.unique((row * n_items + item) * (len(w.row) + 1) + pos)  # a place of a shingle counts once for an item
            pair, pos = pair // (len(w.row) + 1), pair % (len(w.row) + 1)
            first_of, last_of = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]), np.flatnonzero(np.r_[pair[1:] != pair[:-1], True]) + 1
            need = _needed(ix.slots[pair[first_of] % n_items], least)
            enough = last_of - first_of >= need
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for i, j, m in zip(first_of[enough].tolist(), last_of[enough].tolist(), need[enough].tolist(), strict=True):
                r, y = divmod(int(pair[i]), n_items)
                size = min(int(ix.words[y]), int(ends[r + 1] - ends[r]))  # a shorter row is one window
                starts = _window_starts(pos[i:j], m, size - k + 1, int(ends[r]), int(ends[r + 1]) - size)
                if not len(starts):
                    continue
                where = np.searchsorted(at, starts)  # at: the words that begin a shingle, ascending
                prints = simhash_at(s, where, size - k + 1)
                inside = ix.finds(prints, y)
                for chosen in (inside, ~inside):  # those beyond the radius only where none within it passes
                    if (r, y) in best or not chosen.any():
                        continue
                    share, begin = _best_window(s, where[chosen], starts[chosen], size - k + 1, ix.counts[y], int(ix.slots[y]))
                    if share >= least - 1e-9:
                        best[r, y] = (share, -begin)
            out += [(r + base, int(y), share, -begin - int(ends[r])) for (r, y), (share, begin) in best.items()]
    return out


def _needed(slots: np.ndarray, least: float) -> np.ndarray:
    """How many of its shingles a window must hold of an item with so many."""
    return np.maximum(1, np.ceil(least * slots - 1e-9)).astype(np.int64)


def _window_starts(pos: np.ndarray, need: int, length: int, lowest: int, highest: int) -> np.ndarray:
    """All starts from lowest to highest of runs of `length` places that hold at least `need` of the ascending places `pos`."""
    if len(pos) < need:
        return np.zeros(0, np.int64)
    lo, hi = np.maximum(pos[need - 1 :] - length + 1, lowest), np.minimum(pos[: len(pos) - need + 1], highest)
    lo = np.maximum(lo, np.r_[lowest, hi[:-1] + 1])  # intervals ascend; each start once
    at, starts = _spread(lo, np.maximum(lo, hi + 1))
    return starts


def simhash_at(s: np.ndarray, where: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the runs of `length` shingles from each of `where`, some at a time."""
    step = max(1, (1 << 20) // max(1, length))
    parts = [simhash(s[where[i : i + step, None] + np.arange(length)[None, :]]) for i in range(0, len(where), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _best_window(s: np.ndarray, where: np.ndarray, starts: np.ndarray, length: int, counts: Counter, slots: int) -> tuple[float, int]:
    """(share, start) of the window with the largest share of the item's shingles, the first of equals. Counts run from window to
    window where these follow each other."""
    best, begin, held, have, before = -1, 0, 0, Counter(), None
    for x, start in zip(where.tolist(), starts.tolist(), strict=True):
        if before is not None and x == before + 1:
            out, new = int(s[before]), int(s[before + length])
            if out in counts:
                held -= have[out] <= counts[out]
                have[out] -= 1
            if new in counts:
                have[new] += 1
                held += have[new] <= counts[new]
        else:
            have = Counter(g for g in s[x : x + length].tolist() if g in counts)
            held = sum(min(n, counts[g]) for g, n in have.items())
        before = x
        if held > best:
            best, begin = held, start
    return best / slots, begin


def _blocks(items: DataFrame, item_id: str, text: str, most_items: int) -> Iterator[Index]:
    """Indexes of blocks of at most most_items items, by their number in order: each a bounded broadcast, however large the benchmark
    is and however often an item repeats."""
    own = items.select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("text"))
    if own.count() <= most_items:
        blocks = [own]
    else:
        rows = written(numbered(own, ["item", "text"]).withColumn("block", F.floor(F.col("i") / most_items)), "items")
        blocks = [rows.where(F.col("block") == b) for b in range(rows.agg(F.max("block")).head()[0] + 1)]
    for rows in blocks:
        if ix := index([(r["item"], r["text"]) for r in rows.select("item", "text").collect()]):  # most_items rows at most
            yield ix


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.8, most_items: int = 400) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): for each row and each item it holds, the most similar of its windows
    within the radius (if none passes there, of all its windows), the first of equals. Similarity: share of the item's 5-word shingles, by multiplicity, that the window has. Words are
    runs of letters and digits, A-Z lower-cased; an item of fewer than five words is one shingle. Null, empty and wordless
    texts and items match nothing; repeated rows and items each give rows; empty tables give an empty one."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", own.schema["doc_id"].dataType), T.StructField("item_id", items.schema[item_id].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType())])
    out = None
    for ix in _blocks(items, item_id, item_text, most_items):
        given = spark.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            ix = given.value
            for b in batches:
                found = matches(b.column(1), ix, least)
                rows = pa.array([m[0] for m in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), pa.array([ix.ids[m[1]] for m in found], b.column(0).type if not found else None).cast(_arrow(schema["item_id"])), pa.array([m[2] for m in found], pa.float64()), pa.array([m[3] for m in found], pa.int64()), pa.array([int(ix.words[m[1]]) for m in found], pa.int64())],
                    names=schema.names,
                )

        part = own.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _arrow(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.8, most_items: int = 400) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns: the same test as contaminated(), in one pass per
    block of items and without a shuffle. Rows with a null, empty or wordless text stay, as do all rows where there are no items;
    repeated rows fare alike; an empty table gives an empty one; columns of any name pass through."""
    spark = docs.sparkSession
    for ix in _blocks(items, item_id, item_text, most_items):
        key = fresh_name("_text", docs.columns)
        given = spark.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[m[0] for m in matches(b.column(b.num_columns - 1), given.value, least)]] = False
                yield b.select(range(b.num_columns - 1)).filter(pa.array(keep))

        docs = docs.withColumn(key, F.col(text).cast("string")).mapInArrow(run, docs.schema)
    return docs
