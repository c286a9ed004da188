"""Gazetteer, namesake proposals, one case against all, snapshots."""

from itertools import product

from pyspark.sql import functions as F

from casegraph.functions import places as P
from casegraph.functions.similarity import weighted_ratio
from casegraph.plans import resolve, search
from casegraph.sources import snapshots


def test_locate(spark):
    rows = [("IN", None, ("country", "India")), ("in", "x", None), ("ZZ", "Goa", ("city", "Goa")), (None, "seen in NEW DELHI today", ("city", "New Delhi")), ("", "Tamil  Nadu", None), (None, "west bengal police", ("state", "West Bengal")), (None, "Supreme Court of India", ("court", "Supreme Court of India")), (None, "the court", None), (None, None, None), ("Pune road", "Mumbai", ("city", "Pune"))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "id int, a string, b string")
    got = {r["id"]: r["at"] and (r["at"]["precision"], r["at"]["matched"]) for r in df.select("id", P.locate(F.col("a"), F.col("b")).alias("at")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(rows)}


def test_courts_countries_and_events(spark):
    df = spark.createDataFrame([("JUDGMENT", "t", "in Pune", "Punjab and Haryana High Court", "feed"), ("NEWS", "t", "in Pune", "Bombay High Court", "Desk - Chennai"), ("FIR", "t", "x" * 500 + " Pune", None, None)], "kind string, title string, text string, court string, feed string")
    at = P.event_place(F.col("kind"), F.col("title"), F.col("text"), {"court": F.col("court"), "feed": F.col("feed")})
    got = [r["at"] and (r["at"]["precision"], r["at"]["lat"]) for r in df.select(at.alias("at")).collect()]
    assert got == [("state", P.states()["punjab"][0]), ("city", P.CITIES["chennai"][0]), None]
    one = df.select(P.court_point(F.col("court")).alias("c"), P.country_of(F.lit("mu")).alias("n")).collect()
    assert one[0]["c"]["lat"] == P.CITIES["chandigarh"][0] and one[2]["c"] is None and one[0]["n"]["name"] == "Mauritius"


def test_namesakes_are_proposed_as_brute_force_says(spark):
    listed = [(1, "PERSON", "Rajiv Kumar Singh"), (2, "ORGANIZATION", "Blue Star Traders"), (3, "PERSON", "Rajiv")]
    others = [(i, "PERSON", n) for i, n in enumerate(("Rajiv Kumar Singh", "Rajiv K Singh", "Singh Rajiv Kumar", "Rajiv Kumar Singhh", "Rajeev Kumar Singh", "Amit Verma", "Rajiv"), 10)] + [(20, "ORGANIZATION", "Blue Star Traders Ltd"), (21, "PERSON", "Blue Star Traders")]
    schema = "id long, type string, label string"
    known = [(12, 1)]
    got = {(r["a"], r["b"], r["strength"]) for r in resolve.proposed(spark.createDataFrame(listed, schema), spark.createDataFrame(others, schema), spark.createDataFrame(known, "a long, b long")).collect()}
    fit = lambda t, n: len(n) >= 7 and (t != "PERSON" or len(n.split()) >= 2)
    want = set()
    for a, ta, la in listed:
        best = sorted(((-weighted_ratio(la, lb), b) for b, tb, lb in others if ta == tb and fit(ta, la) and fit(tb, lb) and weighted_ratio(la, lb) >= 92))[:3]
        want |= {(a, b, "strong" if -s >= 96 else "probable") for s, b in best if (a, b) not in known and (b, a) not in known}
    assert got == want and len(want) >= 3
    s = {r["id"]: (r["standing"], r["protected"]) for r in resolve.stamped(spark.createDataFrame([(1, "ORGANIZATION", "State of Goa", None), (2, "PERSON", "Witness 1", "accused")], schema + ", court_role string")).collect()}
    assert s == {1: ("institution", False), 2: ("accused", True)}


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert snapshots.load(spark, root, "network") is None and snapshots.status(spark, root, 1).count() == 0
    snapshots.save(spark.range(3), root, "network", 1)
    snapshots.save(spark.range(5), root, "network", 2)
    snapshots.save(spark.range(4), root, "network", 2)
    snapshots.save(spark.range(1), root, "alerts", 3)
    assert snapshots.load(spark, root, "network").count() == 4
    assert {tuple(r) for r in snapshots.status(spark, root, 3).collect()} == {("network", 2, True), ("alerts", 3, False)}
