"""The trie against a dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from casegraph.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, key string, depth string, i string, _part string"


def brute(rows, rebuilt=True):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
        full = {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}
    else:
        full = own
    nodes = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)

    def sums(k):
        below = [sums(x) for x in children.get(k, [])]
        return (sum(x for x, _ in below) or 1) if below else 1, (len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(x for _, x in below)

    out = []
    for k, c in nodes.items():
        ends = ",".join(map(str, sorted(x for x in c if len(full[x]) == len(k))))
        out.append((min(c), len(k), min(nodes[k[:-1]]) if k else None, len(c), len(children.get(k, [])), *sums(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(5)


def query(df):
    c = F.col("conv_id")
    return trie.prefix_trie(df, base=c - c % 5, shared=F.crc32(F.encode(c.cast("string"), "UTF-8")) % 9)


def random_rows(seed, n):
    r, out = random.Random(seed), []
    for c in range(n):
        for t in range(r.randrange(1, 12)):
            out.append((c if r.random() > 0.02 else None, t if r.random() > 0.1 else r.choice([None, 3]), r.choice(["user", "assistant", None]), r.choice(["hi", "hi", "ü", "", None, "w " * 300])))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_dictionary(spark, seed):
    rows = random_rows(seed, 60)
    assert rows_of(query(table(spark, rows))) == brute(rows)
    assert rows_of(trie.prefix_trie(table(spark, rows))) == brute(rows, False)


def test_copies_prefixes_and_turnless(spark):
    long = [(5, t, "user", f"turn {t % 3}") for t in range(400)]  # one conversation of many turns
    copies = [(c, t, "user", "same" if t else "first") for c in range(10, 90) for t in range(4)]  # a large group of copies and of prefixes
    short = [(c, 0, None, None) for c in range(100, 140)]  # most lose their only turn
    rows = long + copies + short + short[:3] + [(c, 0, "user", "first") for c in (1001, 1002)]
    assert rows_of(query(table(spark, rows))) == brute(rows)


def test_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 16)
    rows = [(c, 0, "u", "same") for c in range(900, 1100)]
    assert rows_of(trie.prefix_trie(table(spark, rows))) == brute(rows, False)


def test_none_and_other_ids(spark):
    empty = table(spark, [(1, 1, "a", "b")]).limit(0)
    assert trie.prefix_trie(empty).count() == 0 and query(empty).count() == 0
    assert trie.prefix_trie(table(spark, [(None, 1, "a", "b")])).count() == 0
    with pytest.raises(TypeError):
        trie.turns(spark.createDataFrame([("x", 1, "a", "b")], "conv_id string, turn int, role string, text string"))
