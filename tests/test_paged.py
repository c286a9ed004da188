"""Paged JSON as batches and streams."""

import json

import pytest

from casegraph.sources.paged import Paged


def put(folder, name, body):
    (folder / name).write_text(body if isinstance(body, str) else json.dumps(body))


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(Paged)
    rows = [{"id": str(i), "n": i, "attributes": {"name": f"E{i}", "active": i % 2 == 0, "score": i / 4, "tags": [i]}} for i in range(7)]
    for k, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        put(tmp_path, f"page-{k:03}.json", {"data": part, "meta": {"page": k}})
    put(tmp_path, "page-004.json", "")
    put(tmp_path, "page-005.json", {"data": "none"})
    put(tmp_path, "page-006.json", {"data": [{"id": 9, "n": "x"}, {}, None]})
    put(tmp_path, "_SUCCESS.json", "{")
    return tmp_path


SCHEMA = "id string, n long, name string, active boolean, score double, tags string"


def load(reader, folder):
    reader = reader.format("paged").option("path", str(folder)).option("records", "data").schema(SCHEMA)
    for c in ("name", "active", "score", "tags"):
        reader = reader.option(f"field.{c}", f"attributes.{c}")
    return reader.load()


def test_batch_reads_a_page_a_partition(spark, folder):
    df = load(spark.read, folder)
    assert df.rdd.getNumPartitions() == 6
    got = [tuple(r) for r in df.collect()]
    assert got[:7] == [(str(i), i, f"E{i}", i % 2 == 0, i / 4, f"[{i}]") for i in range(7)]
    assert got[7:] == [("9", None, None, None, None, None), (None,) * 6, (None,) * 6]
    assert load(spark.read, "file://" + str(folder)).count() == 10


def test_filters_reach_the_page(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = load(spark.read.option("pushdown", "true"), folder)
        assert [r.id for r in df.where("n >= 2 and n < 6 and active").collect()] == ["2", "4"]
        assert [r.id for r in df.where("name in ('E1', 'E5') and id <> '5'").collect()] == ["1"]
        assert df.where("n is not null").count() == 7
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_stream_takes_new_pages_only(spark, folder, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        load(spark.readStream, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.n for r in spark.read.parquet(out).where("n is not null").collect())

    assert run() == list(range(7))
    put(folder, "page-007.json", {"data": [{"id": "70", "n": 70}]})
    assert run() == [*range(7), 70] and run() == [*range(7), 70]


def test_no_pages_and_other_types(spark, tmp_path):
    spark.dataSource.register(Paged)
    assert load(spark.read, tmp_path / "nothing").count() == 0
    with pytest.raises(Exception, match="string, long, double or boolean"):
        spark.read.format("paged").option("path", str(tmp_path)).schema("a array<int>").load().count()
