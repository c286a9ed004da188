import pytest
from pyspark.sql import functions as F

from casegraph.functions import geo, keys as K, similarity as S, statutes, text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_ratios():
    assert S.lcs("abcde", "ace") == 3 and S.ratio("abc", "abc") == 100 and S.ratio("abc", "xyz") == 0 and S.ratio("", "") == 100
    assert S.token_set_ratio("kumar ravi", "ravi kumar singh") == 100 and S.token_sort_ratio("b a", "a b") == 100
    assert S.weighted_ratio("Ravi Kumar", "Kumar Ravi") == pytest.approx(95.0) and S.weighted_ratio("", "a") == 0
    assert S.partial_ratio("abc", "zzabczz") == 100


def test_haversine_and_nulls(spark):
    assert one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))) == pytest.approx(6371 * 3.14159265358979 / 2)
    assert one(spark, geo.haversine(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))) is None


def test_located(spark):
    places = spark.createDataFrame([("Delhi", 28.6, 77.2, "city"), ("New Delhi", 28.61, 77.21, "city"), ("Goa", 15.3, 74.1, "state"), ("India", 20.6, 78.9, "country")], "name string, lat double, lon double, precision string")
    docs = spark.createDataFrame([(1, "Seen in New Delhi, India", ""), (2, "", "Goa beaches, India"), (3, "nowhere", None)], "id int, a string, b string")
    got = {r["id"]: (r["matched"], r["precision"]) for r in geo.located(docs, ["a", "b"], places, "id").collect()}
    assert got == {1: ("new delhi", "city"), 2: ("goa", "state")}


def test_jaccard_of_nothing_is_null(spark):
    none = F.array().cast("array<string>")
    assert one(spark, S.jaccard(none, none)) is None and one(spark, S.jaccard(F.array(F.lit("a")), none)) == 0


@pytest.mark.parametrize("bad", range(0, 10))
def test_verhoeff_finds_every_single_error(spark, bad):
    assert one(spark, K.verhoeff(F.lit("2363"))) == 0
    changed = f"2{bad}63"
    assert (one(spark, K.verhoeff(F.lit(changed))) == 0) == (changed == "2363")


def test_protected_parties_are_found(spark):
    rows = [(1, "victim", "A", None, True), (2, None, "Victim of fraud", None, True), (3, "accused", "B", None, False), (4, "police officer", "C", None, True), (5, None, "Sub-Inspector Rao", None, True), (6, None, "Witness 3", None, True), (7, None, "D", "complainant", True), (8, None, "E", "respondent", False), (9, None, None, None, False)]
    df = spark.createDataFrame(rows, "id int, party_role string, label string, record_role string, want boolean")
    assert all(r["p"] == r["want"] for r in df.select("want", K.protected_party({"party_role": F.col("party_role"), "record_role": F.col("record_role")}, F.col("label")).alias("p")).collect())


def test_standing_in_the_record(spark):
    rows = [("ORGANIZATION", "State of Kerala", None, "institution"), ("PERSON", "State of Kerala", None, None), ("ORGANIZATION", "High Court of Delhi", None, "authority"), ("PERSON", "Collector", None, None), ("PERSON", "A. Rao", " Judge", "judge"), ("PERSON", "B", "advocate", None), ("PERSON", "C", "Accused", "accused"), ("ORGANIZATION", None, None, None)]
    df = spark.createDataFrame(rows, "kind string, label string, role string, want string")
    got = df.select("want", K.standing(F.col("kind"), F.col("label"), F.col("role")).alias("s"), K.non_subject({"court_role": F.col("role")}, F.col("label"), F.col("kind")).alias("n")).collect()
    assert all(r["s"] == r["want"] and r["n"] == (r["want"] in ("institution", "authority", "judge")) for r in got)


def test_canonical_keys(spark):
    cases = [("PERSON", "D'Souza", "dsouza"), ("PERSON", "Abdul-Rahim", "abdulrahim"), ("PERSON", "Shri. Md. Salim Khan", "mohd salim khan"), ("PERSON", "Ali Mohammad", "ali mohammad"), ("ORGANIZATION", "A & B Traders Pvt Ltd", "a & b traders"), ("VEHICLE", "dl 01-ab 1234", "DL01AB1234"), ("BANK_ACCOUNT", "A/c 0012 3456", "00123456"), ("BANK_ACCOUNT", "Ravi @YBL", "ravi@ybl"), ("CRYPTO_WALLET", "0xAB-C1", "abc1"), ("SOCIAL_HANDLE", "@The_One", "the_one"), ("LOCATION", "  Old   Delhi ", "old delhi"), ("GOV_ID", "abcde 1234 f", "ABCDE1234F")]
    df = spark.createDataFrame(cases, "kind string, raw string, want string")
    assert all(r["k"] == r["want"] for r in df.select("want", K.canonical_key(F.col("kind"), F.col("raw")).alias("k")).collect())


def test_charges(spark):
    rows = [(1, "u/s 302 and sec 34 IPC; 21(c) NDPS Act"), (2, "s. 304b, 999 I.P.C."), (3, "34 IPC"), (4, "302"), (5, None), (6, ""), (7, "302 IPC; 302 IPC; 302 BNSS"), (8, "21(f) NDPS; 103 BNS")]
    got = statutes.charges(spark.createDataFrame(rows, "id int, c string"), "id", "c")
    by = {(r["id"], r["key"]): r for r in got.collect()}
    assert sorted(by) == [(1, "IPC:302"), (1, "IPC:34"), (1, "NDPS:21(c)"), (2, "IPC:999"), (3, "IPC:34"), (7, "BNSS:302"), (7, "IPC:302"), (8, "BNS:103"), (8, "NDPS:21(f)")]
    assert by[1, "IPC:302"]["offence"] == "Murder" and by[1, "IPC:302"]["equivalent"] == "BNS:103" and by[8, "BNS:103"]["equivalent"] == "IPC:302" and by[1, "NDPS:21(c)"]["gravity"] == 0.95
    assert by[8, "NDPS:21(f)"]["gravity"] == 0.75 and by[2, "IPC:999"]["basis"] == "act" and by[2, "IPC:999"]["gravity"] == 0.45 and by[7, "BNSS:302"]["gravity"] == 0 and by[1, "IPC:302"]["label"] == "s.302 Indian Penal Code"
    s = {r["id"]: r for r in statutes.summary(got, "id").collect()}
    assert s[1]["gravest"] == "IPC:302" and s[1]["categories"] == ["homicide", "narcotics"] and s[3]["gravest"] == "IPC:34" and s[3]["categories"] == [] and s[2]["offence"] == "s.999 Indian Penal Code" and s[1]["keys"] == ["IPC:302", "NDPS:21(c)", "IPC:34"]


def test_plausible_names(spark):
    cases = {"Ravi Kumar": True, "City Police": False, "ravi": False, "राम सिंह": True}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r["n"]: r["ok"] for r in df.select("n", K.plausible_name(F.col("n")).alias("ok")).collect()} == cases


def test_html_and_snippets(spark):
    html = "<html><head><title>T &amp; U</title><script>x<y</script></head><body><!-- c --><nav>menu</nav><article><p>A long enough sentence that has more than forty letters</p><p>short</p><p>Ends well.</p></article></body></html>"
    assert one(spark, T.html_text(F.lit(html))) == "A long enough sentence that has more than forty letters short Ends well."
    assert one(spark, T.readable(F.lit(html))) == "A long enough sentence that has more than forty letters\nEnds well."
    assert one(spark, T.snippet(F.lit("x" * 200 + " Needle  here " + "y" * 200), F.lit("needle"))).startswith("x" * 50)
    assert one(spark, T.snippet(F.lit("abc"), F.lit("zzz"))) is None


def test_identifiers_do_not_overlap(spark):
    docs = spark.createDataFrame([(1, "GSTIN 27AAPFU0939F1ZV and PAN ABCPE1234F, mail a.b@example.com, 9876543210, pay ravi@ybl.")], "doc_id long, text string")
    assert {(r["kind"], r["value"]) for r in T.identifiers(docs).collect()} == {("GSTIN", "27AAPFU0939F1ZV"), ("PAN", "ABCPE1234F"), ("EMAIL", "a.b@example.com"), ("PHONE", "9876543210"), ("UPI", "ravi@ybl")}


def test_sentences_respect_abbreviations(spark):
    assert one(spark, T.sentences(F.lit("Mr. Rao left. He met Dr. Sen. Fine!"))) == ["Mr. Rao left.", "He met Dr. Sen.", "Fine!"]
