"""Working tables and shuffle files go as soon as nothing reads them."""

import os
import random
import time

from pyspark.sql import functions as F

from casegraph.llm import neardup
from casegraph.operators import store
from casegraph.operators.components import components, joined


def tables(path):
    return {x.rpartition("-")[0] for x in os.listdir(path / "casegraph")}


def test_settled_deletes_what_was_written_on_the_way(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda _: f"file://{tmp_path}")
    kept = store.written(spark.range(3), "kept")

    def make():
        inner = store.settled(lambda: store.written(kept, "deep").where("id > 0"), "inner")
        return inner.union(store.written(spark.range(5), "side"))

    out = store.settled(make, "out")
    assert sorted(x["id"] for x in out.collect()) == [0, 1, 1, 2, 2, 3, 4]
    assert tables(tmp_path) == {"kept", "out"}


def test_shuffle_files_go_with_their_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda _: f"file://{tmp_path}")
    removed = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x.name() for x in _blocks(removed) if x.isShuffle()}
    before, setting = shuffles(), spark.conf.get(store.FREED)
    store.written(spark.range(1000).groupBy(F.col("id") % 7).count(), "counts")
    assert spark.conf.get(store.FREED) == setting
    for _ in range(50):  # they are removed by another thread
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before


def _blocks(disk):
    found = disk.getAllBlocks()
    return [found.apply(i) for i in range(found.size())]


def test_components_leave_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda _: f"file://{tmp_path}")
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 41)], "a long, b long")
    got = store.settled(lambda: components(links), "nodes")
    assert {(x["node"], x["component"]) for x in got.collect()} == {(i, 0) for i in range(21)} | {(40, 40), (41, 40)}
    assert tables(tmp_path) == {"nodes"}


def test_few_and_many_links(spark, monkeypatch):
    r = random.Random(8)
    links = [(r.randrange(150), r.randrange(150)) for _ in range(90)] + [(999, i) for i in range(200, 230)]
    frame = spark.createDataFrame(links, "a long, b long")
    rows = lambda: sorted((x["node"], x["component"]) for x in components(frame).collect())
    of = {x: x for x in {x for a, b in links if a != b for x in (a, b)}}
    while new := {x: min(of[a], of[b]) for a, b in links if a != b for x in (a, b) if min(of[a], of[b]) < of[x]}:
        of |= new
    broadcast = rows()
    monkeypatch.setattr("casegraph.operators.components.FEW", 0)
    assert broadcast == rows() == sorted(of.items())


def test_further_links_join_components(spark):
    r = random.Random(5)
    for most in (0, 1000):
        old = [(r.randrange(60), r.randrange(60)) for _ in range(25)]
        new = [(r.randrange(90), r.randrange(90)) for _ in range(20)] + [(7, 7), (None, 3)]
        old, new = [x for x in old if x[0] != x[1]], [x for x in new if x[0] != x[1] or x == (7, 7)]
        frame = lambda x: spark.createDataFrame(x, "a long, b long")
        rows = lambda df: sorted((x["node"], x["component"]) for x in df.collect())
        assert rows(joined(components(frame(old)), frame(new), most)) == rows(components(frame(old + new)))
    none = spark.createDataFrame([], "node long, component long")
    assert rows(joined(none, frame(old), 10)) == rows(components(frame(old)))
    assert rows(joined(components(frame(old)), frame([]), 10)) == rows(components(frame(old)))


def test_near_duplicates_keep_few_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda _: f"file://{tmp_path}")
    r = random.Random(3)
    rows = []
    for i in range(12):
        w = [f"w{r.randrange(10**6)}" for _ in range(300)]
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join([*w[:-1], "end"])), (3 * i + 2, " ".join([*w[:-30], *(f"x{i}y{j}" for j in range(30))]))]
    got = neardup.similar_clusters(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(x["doc_id"], x["component_id"]) for x in got.collect()} == {(d, d - d % 3) for d, _ in rows}
    assert tables(tmp_path) <= {"rows", "distinct", "nodes"}
