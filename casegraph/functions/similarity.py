"""String and vector similarity. Scorers beyond built-in functions are Arrow-batched."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = row & at.get(c, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 100.0 * 2 * lcs(a, b) / n


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of its length in the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(ratio(short, w) for w in windows if w)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, da, db = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not da or not db):
        return 100.0
    ca, cb = f"{both} {da}".strip(), f"{both} {db}".strip()
    return max(ratio(ca, cb), ratio(both, ca) if both else 0.0, ratio(both, cb) if both else 0.0)


def weighted_ratio(a: str, b: str) -> float:
    """The best of plain, token and partial ratios, weighted by how different the lengths are."""
    if not a or not b:
        return 0.0
    by = max(len(a), len(b)) / min(len(a), len(b))
    token = max(token_sort_ratio(a, b), token_set_ratio(a, b))
    if by < 1.5:
        return max(ratio(a, b), 0.95 * token)
    scale = 0.9 if by < 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), token_set_ratio(a, b)))


SCORERS = {"ratio": ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "weighted": weighted_ratio}


def scored(pairs: DataFrame, a: str, b: str, scorer: str = "weighted", name: str = "score") -> DataFrame:
    """`pairs` with a score of 0 to 100 for two text columns; a null text scores 0."""
    f = SCORERS[scorer]

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([f(p, q) if p is not None and q is not None else 0.0 for p, q in zip(x, y)], dtype="float64")

    return pairs.withColumn(name, run(a, b))


def blocks(x: Column) -> Column:
    """Blocking key of a name: the first letter of its canonical form."""
    return F.substring(F.lower(F.trim(x)), 1, 1)
