from pyspark.sql import functions as F

from casegraph.functions import text as T
from casegraph.plans import resolve, search


def test_documents_are_kept_once_and_thin_ones_return(spark):
    d = spark.createDataFrame([("1", "NEWS", "A", "short", 2), ("2", "NEWS", "A", "short", 1), ("3", "NEWS", "B", "x" * 500, 1), ("4", "NEWS", "C", None, 1)], "id string, source_type string, title string, content string, ingested_at int")
    assert {r["id"] for r in resolve.deduplicated_documents(d).collect()} == {"2", "3", "4"}
    done = spark.createDataFrame([("2",)], "id string")
    fetched = spark.createDataFrame([("1", "a longer text"), ("2", "a longer text"), ("3", "y" * 900), ("4", "text"), ("5", "z")], "id string, text string")
    assert {r["id"]: r["content"] for r in resolve.thin_documents(d, done, fetched).collect()} == {"1": "a longer text", "4": "text"}


def test_reset_keeps_what_is_structured(spark):
    e = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "id string")
    ev = spark.createDataFrame([("r1", "rules"), ("r1", "structured"), ("r2", "rules"), (None, "llm")], "relationship_id string, extractor string")
    edges, evidence = resolve.without_text_extraction(e, ev)
    assert {r["id"] for r in edges.collect()} == {"r1", "r3"} and evidence.count() == 1


def test_first_attribute_wins_but_unverified_gives_way(spark):
    rows = spark.createDataFrame([("a", 1, {"kyc": "Unverified", "age": ""}), ("a", 2, {"kyc": "verified", "age": "30"}), ("a", 3, {"age": "31"})], "id string, order int, attributes map<string,string>")
    assert resolve.merged_attributes(rows).head()["attributes"] == {"age": "30", "kyc": "verified"}


def test_alert_words(spark):
    r = spark.range(1).select(T.burst_text(F.lit(1234567.0), F.lit(0.876), F.lit(4)).alias("x")).head()
    assert r["x"] == "Rs 1,234,567 from 4 senders, 88% of all that came in"


def test_tfidf_is_the_formula(spark):
    import math

    docs = spark.createDataFrame([(1, "red house red"), (2, "the red river"), (3, ""), (4, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): r["w"] for r in search.tfidf(docs, "doc_id", "text").collect()}
    idf = lambda df: math.log(5 / (1 + df)) + 1
    raw = {"red": 2 * idf(2), "house": idf(1), "red house": idf(1), "house red": idf(1)}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert {t: round(w, 9) for (d, t), w in got.items() if d == 1} == {t: round(v / norm, 9) for t, v in raw.items()}
    assert {t for d, t in got if d == 2} == {"red", "river", "red river"}
