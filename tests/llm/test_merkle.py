"""The manifest against a plain recursion over lists."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from casegraph.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, run long, leaf string, root string, `from` string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(row):
    return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def tree(nodes):
    """All levels of a tree, from its leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        out += level[i ^ 1 : (i ^ 1) + 1]
        i //= 2
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain(r)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([d for *_, d in sorted(groups[x])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, (some, d, digest) in enumerate(sorted(groups[x])):
            out.append((d if some else None, digest, trees[x][-1][0], top[-1][0], "".join(way(trees[x], i) + way(top, k))))
    return out


def table(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "a", 1, "b", "c", "d") for r in rows], SCHEMA).repartition(4)


def made(seed, counts):
    r, out = random.Random(seed), []
    for lang, n in counts.items():
        for i in range(n):
            out.append({"doc_id": 3 * i + seed, "lang": lang, "source": r.choice([None, "", "web"]), "n_chars": r.choice([None, 0, 7]), "text": r.choice([None, "", "words ü", "x" * 50_000])})
    r.shuffle(out)
    return out


@pytest.mark.parametrize("counts", [{"en": 1}, {"en": 2, None: 3}, {None: 1, "": 1, "de": 5, "é": 9, "z": 2}, {"en": 600, "de": 256, "fr": 257, None: 255, "it": 1}])
def test_against_recursion(spark, counts):
    rows = made(1, counts)
    got = merkle.manifest(table(spark, rows), keep={"n": F.col("n_chars"), "leaf2": F.col("text")})
    got = got.withColumn("back", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("text", merkle.siblings(F.col("path"))).collect()
    assert all(r.back == r.root for r in got)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.text) for r in got), key=key) == sorted(brute(rows), key=key)
    assert {(r.doc_id, r.n) for r in got} == {(r["doc_id"], r["n_chars"]) for r in rows}


def test_three_groups_of_levels(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = made(2, {"en": 75, "de": 16, "fr": 17, "it": 4, "es": 5, "pt": 1, None: 3})
    got = merkle.manifest(table(spark, rows)).withColumn("text", merkle.siblings(F.col("path"))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.text) for r in got), key=key) == sorted(brute(rows), key=key)


def test_repeats_nulls_and_no_rows(spark):
    row = {"doc_id": None, "lang": "en", "source": None, "n_chars": None, "text": None}
    rows = [row] * 9 + [{**row, "doc_id": 4}] * 3 + [{**row, "doc_id": 4, "text": "t"}]
    got = merkle.manifest(table(spark, rows)).withColumn("text", merkle.siblings(F.col("path"))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.text) for r in got), key=key) == sorted(brute(rows), key=key)
    assert merkle.manifest(table(spark, rows).limit(0)).count() == 0


def test_a_changed_row_is_found(spark):
    docs = table(spark, made(3, {"en": 20}))
    changed = merkle.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.coalesce("n_chars", F.lit(0)) + 1, F.col("text")])
    got = merkle.manifest(docs, keep={"now": F.when(F.col("doc_id") == 3, changed).otherwise(merkle.leaf([F.col(c) for c in COLUMNS]))})
    assert {r.doc_id for r in got.where(merkle.folded(F.col("now"), F.col("path")) != F.col("root")).collect()} == set() | {r.doc_id for r in docs.where("doc_id = 3").collect()}
