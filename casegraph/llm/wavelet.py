"""Token ids in wavelet-matrix shards.

A shard is one blob: a header, the first token of each document, and for every bit of the ids a bit-plane with its count of zeros.
A plane is stored in blocks of BLOCK bytes, each compressed on its own, with a rank directory: the ones before each block. Access,
rank, counting and occurrence lookup work on the stored bytes: each level reads the directory and one block, select one block more
found by binary search in the directory, so no plane is inflated as a whole. Shards hold whole documents in ascending doc_id order.

Layout, little-endian: magic WVM2, uint32 header length, JSON header (tokens, docs, bits, zeros by plane, byte lengths),
zstd of int64 doc_ids (first as it is, then differences) and a null flag for each, zstd of uint32 token counts, then for each plane
uint32 ones before each block, uint32 end of each block within the plane, zstd of each block.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.store import written
from ._words import Words, mixed, sliced

MAGIC = b"WVM2"
BLOCK = 4096
SHARD_TOKENS = 1 << 18
CACHE_PIECES = 2_000_000
SLICE = 2 << 20
LEVEL = 1


# --- one shard ---


def encode(ids: np.ndarray, docs: list[int | None], counts: np.ndarray) -> bytes:
    """The blob of a shard: ids of all its documents one after the other, their doc_ids and token counts."""
    a = np.ascontiguousarray(ids, np.uint32)
    bits = max(1, int(a.max(initial=0)).bit_length())
    a = a.astype(np.uint16) if bits <= 16 else a
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    planes, zeros = [], []
    for bit in range(bits - 1, -1, -1):
        one = (a & a.dtype.type(1 << bit)) != 0
        raw = np.packbits(one, bitorder="little")
        blocks = [pack(raw[i : i + BLOCK].tobytes()) for i in range(0, len(raw), BLOCK)]
        ones = np.add.reduceat(np.bitwise_count(raw), np.arange(0, len(raw), BLOCK), dtype=np.int64) if len(raw) else np.zeros(0, np.int64)
        before = np.cumsum(ones) - ones
        planes.append(b"".join([before.astype("<u4").tobytes(), np.cumsum([len(x) for x in blocks]).astype("<u4").tobytes(), *blocks]))
        low = np.compress(~one, a)
        zeros.append(len(low))
        a = np.concatenate([low, np.compress(one, a)])
    known = np.array([d if d is not None else 0 for d in docs], np.int64)
    keys = pack(np.diff(known, prepend=np.int64(0)).tobytes() + np.array([d is None for d in docs], np.uint8).tobytes())
    sizes = pack(np.ascontiguousarray(counts, "<u4").tobytes())
    head = json.dumps({"tokens": len(ids), "docs": len(docs), "bits": bits, "zeros": zeros, "keys": len(keys), "sizes": len(sizes), "planes": [len(p) for p in planes]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, keys, sizes, *planes])


class Shard:
    """Reads a blob. Blocks are decompressed when needed; the last few stay."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        n = int.from_bytes(blob[4:8], "little")
        self.head = json.loads(blob[8 : 8 + n])
        self.tokens, self.bits, self.zeros = self.head["tokens"], self.head["bits"], self.head["zeros"]
        self.blocks = -(-self.tokens // (8 * BLOCK))
        self._blob, self._at = blob, 8 + n
        self._unpack = zstandard.ZstdDecompressor().decompress
        sizes = np.cumsum([0, self.head["keys"], self.head["sizes"], *self.head["planes"]])
        self._first = (self._at + sizes).tolist()
        self._kept: dict[tuple[int, int], np.ndarray] = {}

    def _part(self, k: int) -> bytes:
        return self._unpack(self._blob[self._first[k] : self._first[k + 1]])

    def _directory(self, level: int, k: int) -> np.ndarray:
        """Of a level: ones before each block (k = 0), ends of the blocks (k = 1); a view of the stored bytes."""
        return np.frombuffer(self._blob, "<u4", self.blocks, self._first[2 + level] + 4 * self.blocks * k)

    def block(self, level: int, b: int) -> np.ndarray:
        """The bytes of block b of a level."""
        if (level, b) not in self._kept:
            ends, first = self._directory(level, 1), self._first[2 + level] + 8 * self.blocks
            raw = np.frombuffer(self._unpack(self._blob[first + (int(ends[b - 1]) if b else 0) : first + int(ends[b])]), np.uint8)
            if len(self._kept) >= 4 * self.bits:
                self._kept.pop(next(iter(self._kept)))
            self._kept[level, b] = raw
        return self._kept[level, b]

    def docs(self) -> list[int | None]:
        raw, n = self._part(0), self.head["docs"]
        known = np.cumsum(np.frombuffer(raw[: 8 * n], "<i8"))
        return [None if null else int(d) for d, null in zip(known, raw[8 * n :], strict=True)]

    def counts(self) -> np.ndarray:
        return np.frombuffer(self._part(1), "<u4")

    def plane(self, level: int) -> np.ndarray:
        """Ones and zeros of a whole level as booleans, for reading everything; level 0 is the highest bit."""
        ends, first = self._directory(level, 1).tolist(), self._first[2 + level] + 8 * self.blocks
        raw = b"".join(self._unpack(self._blob[first + a : first + b]) for a, b in zip([0, *ends], ends))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=self.tokens, bitorder="little").view(bool)

    def _bit(self, level: int, i: int) -> int:
        return int(self.block(level, i // (8 * BLOCK))[i % (8 * BLOCK) // 8]) >> (i % 8) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i: from the directory, then within one block."""
        if i >= self.tokens:
            return self.tokens - self.zeros[level]
        b, i = divmod(i, 8 * BLOCK)
        raw = self.block(level, b)
        return int(self._directory(level, 0)[b]) + int(np.bitwise_count(raw[: i // 8]).sum()) + (int(raw[i // 8]) & (1 << i % 8) - 1).bit_count()

    def all(self) -> np.ndarray:
        """Every id, by undoing the levels from the last."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        a = np.zeros(self.tokens, kind)
        for level in range(self.bits - 1, -1, -1):
            one = self.plane(level)
            b = np.empty_like(a)
            b[np.flatnonzero(~one)] = a[: self.zeros[level]]
            b[np.flatnonzero(one)] = a[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            a = b
        return a.astype(np.uint32)

    def access(self, i: int) -> int:
        """The id at position i."""
        out = 0
        for level in range(self.bits):
            ones = self._ones(level, i)
            if self._bit(level, i):
                out, i = out << 1 | 1, self.zeros[level] + ones
            else:
                out, i = out << 1, i - ones
        return out

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        first, last = self._range(token, i)
        return last - first

    def count(self, token: int) -> int:
        return self.rank(token, self.tokens)

    def select(self, token: int, k: int) -> int:
        """Position of occurrence k (from 0) of a token."""
        first, last = self._range(token, self.tokens)
        if not 0 <= k < last - first:
            raise IndexError("no such occurrence")
        i = first + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bool(one), i - self.zeros[level] if one else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def _range(self, token: int, i: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        first, last = 0, i
        for level in range(self.bits):
            a, b = self._ones(level, first), self._ones(level, last)
            if token >> (self.bits - 1 - level) & 1:
                first, last = self.zeros[level] + a, self.zeros[level] + b
            else:
                first, last = first - a, last - b
        return first, last

    def _select(self, level: int, one: bool, k: int) -> int:
        """Position of the k-th one or zero of a level."""
        before = self._directory(level, 0).astype(np.int64)
        have = before if one else np.arange(self.blocks) * 8 * BLOCK - before
        b = int(np.searchsorted(have, k, "right")) - 1
        raw, k = self.block(level, b), k - int(have[b])
        counts = np.cumsum(np.bitwise_count(raw if one else ~raw), dtype=np.int64)
        byte = int(np.searchsorted(counts, k, "right"))
        within = np.flatnonzero(np.unpackbits(raw[byte : byte + 1], bitorder="little") == one)
        return (b * BLOCK + byte) * 8 + int(within[k - (int(counts[byte - 1]) if byte else 0)])


# --- tokens ---


class Table:
    """Open-addressed table from non-zero 64-bit keys to numbers, all operations on arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is missing."""
        out = np.full(len(keys), -1, np.int32)
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            have = self.keys[at]
            same = have == keys[todo]
            out[todo[same]] = self.values[at[same]]
            on = ~same & (have != 0)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds different keys that are not there."""
        if (self.size + len(keys)) * 2 > len(self.keys):
            used = self.keys != 0
            old = self.keys[used], self.values[used]
            self.__init__(max(self.bits + 1, int(4 * (self.size + len(keys))).bit_length()))
            self.put(*old)
        self.size += len(keys)
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            slot, first = np.unique(at, return_index=True)
            first = first[self.keys[slot] == 0]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & ((1 << self.bits) - 1)


_PIECE = np.ones(256, bool)
_PIECE[32] = False
_BAD = -2
_FIRST = np.uint64(0xA5A5A5A5A5A5A5A5)


class Encoder:
    """Ids by the tokenizers library. Where a single space stands between two other characters that are no white space, a
    byte-level BPE always begins a piece, so the pieces there are encoded apart, each different piece once: it is found by
    64 bits of hash, and its bytes are compared. New pieces are encoded side by side in one text and cut where their bytes end."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())
        kind = model.get("pre_tokenizer") or {}
        added = model.get("added_tokens") or []
        self.pieces = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not model.get("normalizer")
        self.pieces = self.pieces and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(tokens.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        for t, i in tokens.items():
            self.bytes[i] = len(t)
        for t in added:
            self.bytes[t["id"]] = len(t["content"].encode())
        self._empty()

    def _empty(self) -> None:
        self.table, self.known, self.used = Table(), 0, 0
        self.flat, self.first = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.raw, self.raw_first = np.zeros(1 << 16, np.uint8), np.zeros(1 << 14, np.int64)

    def _learn(self, keys: np.ndarray, pieces: list[bytes], spaced: np.ndarray) -> None:
        """keys: of different new pieces; spaced: a space stands before the piece. Pieces whose white space may join that around
        them are marked as bad."""
        text = [p.decode() for p in pieces]
        bad = np.fromiter((t[-1].isspace() or s and t[0].isspace() for t, s in zip(text, spaced, strict=True)), bool, len(text))
        self.table.put(keys[bad], np.full(bad.sum(), _BAD, np.int32))
        alone = np.flatnonzero(~bad & ~spaced)
        joined = np.flatnonzero(~bad & spaced)
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([text[i] for i in alone], add_special_tokens=False)]
        size = [len(x) for x in ids]
        parts = [np.array(x, np.uint32) for x in ids]
        for i in range(0, len(joined), 2000):
            some = joined[i : i + 2000]
            got = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(text[k] for k in some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.bytes[got]), np.cumsum([len(pieces[k]) + 1 for k in some])) + 1
            size += np.diff(ends, prepend=0).tolist()
            parts.append(got)
        order, new = np.concatenate([alone, joined]), np.concatenate([*parts, np.zeros(0, np.uint32)])
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(new), len(self.flat)), np.uint32)])
        if self.known + len(order) + 1 > len(self.first):
            more = np.zeros(max(len(order) + 1, len(self.first)), np.int64)
            self.first, self.raw_first = np.concatenate([self.first, more]), np.concatenate([self.raw_first, more])
        data = np.frombuffer(b"".join([pieces[k] for k in order]), np.uint8)
        have = int(self.raw_first[self.known])
        if have + len(data) > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros(max(len(data), len(self.raw)), np.uint8)])
        self.raw[have : have + len(data)] = data
        self.raw_first[self.known + 1 : self.known + 1 + len(order)] = have + np.cumsum([len(pieces[k]) for k in order])
        self.flat[self.used : self.used + len(new)] = new
        self.first[self.known + 1 : self.known + 1 + len(order)] = self.used + np.cumsum(size)
        self.table.put(keys[order], np.arange(self.known, self.known + len(order), dtype=np.int32))
        self.known, self.used = self.known + len(order), self.used + len(new)

    def whole(self, text: str | None) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32) if text else np.zeros(0, np.uint32)

    def _other(self, w: Words, at: np.ndarray) -> np.ndarray:
        """Words whose bytes are not those of the known piece of number `at`; words without one (negative) are left out."""
        good = np.flatnonzero(at >= 0)
        start, first = w.start[good], self.raw_first[at[good]]
        n, have = w.end[good] - start, self.raw_first[at[good] + 1] - first
        odd = np.flatnonzero(n != have)
        n = np.minimum(n, have)
        steps, ends = np.arange(n.sum(), dtype=np.int32), np.cumsum(n)
        own = w.raw[steps + np.repeat((start - (ends - n)).astype(np.int32), n)]
        wrong = np.flatnonzero(own != self.raw[steps + np.repeat((first - (ends - n)).astype(np.int32), n)])
        return good[np.concatenate([odd, np.searchsorted(ends, wrong, "right")])]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; a null text has none."""
        if not self.pieces:
            for t in texts:
                yield self.whole(t.as_py())
            return
        for base, last, w in sliced(texts, _PIECE, fold=False, most=SLICE):
            if self.known > CACHE_PIECES:
                self._empty()
            n, rows = len(w.start), last - base
            lead = np.ones(n, bool)
            lead[1:] = w.row[1:] != w.row[:-1]
            keys = mixed(w.word_hash() + (w.end - w.start).astype(np.uint64)) ^ np.where(lead, _FIRST, np.uint64(0))
            keys[keys == 0] = 1
            at = self.table.get(keys)
            if len(miss := np.flatnonzero(at == -1)):
                new, where = np.unique(keys[miss], return_index=True)
                where = miss[where]
                raw = w.raw.tobytes()
                self._learn(new, [raw[a:b] for a, b in zip(w.start[where].tolist(), w.end[where].tolist(), strict=True)], ~lead[where])
                at[miss] = self.table.get(keys[miss])
            # rows with spaces at an end or side by side, with bad pieces or with a piece whose hash another has, are encoded as wholes
            odd = np.bincount(w.row[at == _BAD], minlength=rows) > 0
            space = np.bincount(np.searchsorted(w.bounds, np.flatnonzero(w.raw == 32), "right") - 1, minlength=rows)
            odd |= space != np.maximum(np.bincount(w.row, minlength=rows) - 1, 0)
            odd |= np.bincount(w.row[self._other(w, at)], minlength=rows) > 0
            at = np.maximum(at, 0)
            first = self.first[at]
            size = self.first[at + 1] - first
            ids = self.flat[np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)] if n else np.zeros(0, np.uint32)
            ends = np.cumsum(np.bincount(w.row, weights=size, minlength=rows).astype(np.int64))
            for r in range(rows):
                yield self.whole(texts[base + r].as_py()) if odd[r] else ids[(ends[r - 1] if r else 0) : ends[r]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for all tasks of a worker process, so that known pieces stay known."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenised(docs: DataFrame, path: str, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shards (part, seq, part_start, tokens, docs, blob) of all documents, written to the shared folder. Parts are ranges of
    doc_id (nulls first), seq orders the shards of a part, part_start counts the tokens of the part before a shard. Null and empty
    texts have the end id only. A shard is closed once it has `shard_tokens` tokens; a document is never split. Rows that repeat a
    doc_id stand together, the shorter text first; an empty table gives an empty one; other columns are not read. doc_id has to be a
    number (the format stores 64-bit integers): TypeError otherwise."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} has to be an integer column")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = own.repartitionByRange(n, "doc_id", F.octet_length("text")).sortWithinPartitions("doc_id", F.octet_length("text"), "text")
    end = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, done, held = 0, 0, 0
        ids: list[np.ndarray] = []
        keys: list[int | None] = []

        def shard() -> pa.RecordBatch:
            blob = encode(np.concatenate(ids), keys, np.array([len(x) for x in ids]))
            return pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([done], pa.int64()), pa.array([held], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([blob], pa.binary())], names=["seq", "part_start", "tokens", "docs", "blob"])

        for b in batches:
            for key, x in zip(b.column(0).to_pylist(), encoder(path).encode(b.column(1)), strict=True):
                ids.append(np.concatenate([x, np.array(end, np.uint32)]))
                keys.append(key)
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield shard()
                    seq, done, held, ids, keys = seq + 1, done + held, 0, [], []
        if keys:
            yield shard()

    shards = own.mapInArrow(run, "seq long, part_start long, tokens long, docs long, blob binary")
    return written(shards.withColumn("part", F.spark_partition_id()), "shards")


def starts(shards: DataFrame) -> DataFrame:
    """`shards` with start: the tokens of all shards before it. Sums go over parts only (as many rows as partitions)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_offset"))
    return shards.join(F.broadcast(parts), "part").withColumn("start", F.col("part_offset") + F.col("part_start")).drop("part_offset")


def read_back(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' bytes: a row for each document of tokenised(), null
    and repeated ids included; no rows for no shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(blob.as_py())
                counts = s.counts().astype(np.int64)
                last = np.cumsum(counts)
                raw = memoryview(s.all().astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(last.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.docs(), pa.int64()), pa.array(begin + last - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts(shards).select("start", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
