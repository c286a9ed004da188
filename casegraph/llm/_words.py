"""Vectorised word splitting and hashing over Arrow string columns, for use inside mapInArrow.

A batch is cut into slices of about a megabyte, whose arrays stay small; a longer text is a slice of its own. In a slice every word has its start, end, row and a
64-bit polynomial hash that comes from prefix sums over the bytes, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes of a word when ASCII punctuation separates: digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def _grown(n: int) -> None:
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (splitmix64)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    raw: np.ndarray  # the slice's bytes as they are
    buf: np.ndarray  # what is hashed: lower-cased A-Z, unless fold is off
    bounds: np.ndarray  # byte offsets of the rows, one more than rows
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # row of each word within the slice
    prefix: np.ndarray  # prefix sums for hash()

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return mixed((self.prefix[end] - self.prefix[start]) * _powers[1][start])

    def word_hash(self) -> np.ndarray:
        return self.hash(self.start, self.end)

    def rows_from(self) -> np.ndarray:
        """Index of the first word of each row, and the number of words at the end."""
        return np.searchsorted(self.row, np.arange(len(self.bounds)))


def rolled(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words, and at which word each starts; runs do not cross rows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : n + j]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mixed(out[at]), at


def sliced(column: pa.Array | pa.ChunkedArray, is_word: np.ndarray = ALNUM, most: int = SLICE_BYTES, fold: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of successive slices; a null text has no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], is_word, fold)
        first = last


def words(raw: np.ndarray, bounds: np.ndarray, is_word: np.ndarray = ALNUM, fold: bool = True) -> Words:
    n = len(raw)
    _grown(n + 1)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[raw]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = inside[cut + 1]
    ends[cut - 1] = inside[cut]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    buf = LOWER[raw] if fold else raw
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[buf] * _powers[0][:n], out=prefix[1:])
    return Words(raw, buf, bounds, start, end, np.searchsorted(bounds, start, "right") - 1, prefix)
