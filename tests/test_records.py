import json
import os

import pytest
from pyspark.sql import functions as F

from casegraph.plans import dossier, extract, ledger, resolve, search
from casegraph.sources import readers as R
from casegraph.streaming import edges as SE
from casegraph.streaming import watches as W


# --- ledger ---


def entries(n):
    return ledger.append([{"timestamp": f"t{i}", "actor": 'a "q" \\', "action": "ADD", "subject_type": "doc", "subject_id": str(i), "payload": {"b": i, "a": 1}} for i in range(n)], None)


def test_chain_is_whole_and_tampering_shows(spark):
    rows = entries(20)
    more = ledger.append([{"action": "X"}], rows[-1])
    assert more[0]["index"] == 20 and more[0]["previous_hash"] == rows[-1]["entry_hash"]
    df = lambda: spark.createDataFrame(rows)
    assert ledger.broken(df()).collect() == []
    rows[5]["actor"] = "someone else"
    assert [(r["index"], r["why"]) for r in ledger.broken(df()).collect()] == [(5, "content")]
    rows[5]["entry_hash"] = ledger.entry_hash(rows[5])
    assert ledger.first_break(df()).head()["why"] == "link"


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_every_leaf_is_proven(spark, n):
    leaves = [ledger.digest(str(i)) for i in range(n)]
    df = spark.createDataFrame(list(enumerate(leaves)), "i long, hash string")
    root = ledger.merkle_root(df)
    for i in range(n):
        proof = ledger.inclusion_proof(df, i)
        assert ledger.proven(leaves[i], proof, root) and not ledger.proven(ledger.digest("x"), proof, root)
    level = leaves
    while len(level) > 1:
        level = [ledger.digest(level[j] + level[min(j + 1, len(level) - 1)]) for j in range(0, len(level), 2)]
    assert root == level[0] and ledger.merkle_root(df.limit(0)) == "0" * 64


def test_signatures(spark):
    # the first test vector of RFC 8032
    key = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = ledger.public_key(key)
    assert public.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    s = ledger.sign(key, b"")
    assert s.hex() == "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"
    assert ledger.verify(public, b"", s) and not ledger.verify(public, b"x", s) and not ledger.verify(public, b"", s[:-1] + b"\0")
    rows = entries(3)
    for r in rows:
        r["signature"] = ledger.sign(key, r["entry_hash"].encode()).hex()
    rows[1]["signature"] = rows[0]["signature"]
    assert [r["index"] for r in ledger.bad_signatures(spark.createDataFrame(rows), public).collect()] == [1]


# --- watches and streams ---

DOC = "id string, title string, content string, occurred_at timestamp_ntz"


def watch_table(spark):
    return spark.createDataFrame([("w1", "TEXT", "silver van", True), ("w2", "TEXT", "gold", False), ("w3", "PHONE", "9876543210", True)], "id string, kind string, norm string, active boolean")


def test_stream_equals_batch_and_replay_adds_nothing(spark, tmp_path):
    drops = [[("d1", "Note", "A Silver  van. silver van seen", None), ("d2", "x", "nothing", None)], [("d3", "silver VAN", "", None)]]
    folder, hits = str(tmp_path / "docs"), str(tmp_path / "hits")
    for i, rows in enumerate(drops):
        spark.createDataFrame(rows, DOC).write.mode("append").parquet(folder)
        q = W.stream(spark.readStream.schema(DOC).parquet(folder), watch_table(spark), hits, str(tmp_path / "ck"))
        q.awaitTermination()
    got = {(r["watch_id"], r["document_id"]) for r in spark.read.parquet(hits).collect()}
    whole = W.text_hits(spark.read.schema(DOC).parquet(folder), watch_table(spark))
    assert got == {("w1", "d1"), ("w1", "d3")} == {(r["watch_id"], r["document_id"]) for r in whole.collect()}
    W.scan(spark.read.schema(DOC).parquet(folder), watch_table(spark), hits)
    assert spark.read.parquet(hits).count() == 2 and W.tally(spark.read.parquet(hits)).head()["hit_count"] == 2


def test_watch_context_precedence_and_selectors(spark):
    m = spark.createDataFrame([("d1", "e1", "PHONE", "9876543210", "edge", None, 3), ("d1", "e1", "PHONE", "9876543210", "evidence", None, 1), ("d2", "e1", "PHONE", "1", "no", None, 1)], "document_id string, entity_id string, type string, key string, snippet string, occurred_at timestamp_ntz, rank int")
    assert [(r["document_id"], r["snippet"]) for r in W.key_hits(m, watch_table(spark)).collect()] == [("d1", "evidence")]
    rows = [("PHONE", "+91 98765 43210"), ("PHONE", "1234567"), ("VEHICLE", "dl 01 ab 1234"), ("VEHICLE", "dl1"), ("TEXT", " Silver  Van "), ("TEXT", "van"), ("PERSON", "Shri D'Souza"), ("PERSON", "x"), ("CAR", "x"), ("TEXT", None), ("GOV_ID", "abcpe1234f"), ("GOV_ID", "1234 1234 1234"), ("GOV_ID", "SBIN0001234"), ("GOV_ID", "hello")]
    got = {(r["kind"], r["value"]): (r["norm"], r["display"], r["error"]) for r in W.normalised(spark.createDataFrame(rows, "kind string, value string"), "salt").collect()}
    assert got["PHONE", "+91 98765 43210"][0] == "9876543210" and got["VEHICLE", "dl 01 ab 1234"][0] == "DL01AB1234" and got["TEXT", " Silver  Van "][0] == "silver van" and got["PERSON", "Shri D'Souza"][:2] == ("dsouza", "Shri D'Souza")
    bad = {k for k, v in got.items() if v[0] is None}
    assert bad == {("PHONE", "1234567"), ("VEHICLE", "dl1"), ("TEXT", "van"), ("PERSON", "x"), ("CAR", "x"), ("TEXT", None), ("GOV_ID", "1234 1234 1234"), ("GOV_ID", "SBIN0001234"), ("GOV_ID", "hello")} and all(got[k][2] for k in bad)
    norm, shown, _ = got["GOV_ID", "abcpe1234f"]
    assert norm.startswith("fp:") and len(norm) == 35 and shown == "ABCXX1234X"
    stored = spark.createDataFrame([("w1", "TEXT", "silver van", "silver van", False)], "id string, kind string, norm string, display string, active boolean")
    new = W.normalised(spark.createDataFrame([("w9", "text", "Silver van"), ("w8", "PHONE", "9876543210"), ("w7", "PHONE", "09876543210"), ("w6", "TEXT", "no")], "id string, kind string, value string"))
    assert sorted(tuple(r) for r in W.added(stored, new).collect()) == [("w1", "TEXT", "silver van", "silver van", True), ("w7", "PHONE", "9876543210", "9876543210", True)]


def test_incremental_edges_equal_one_batch(spark, tmp_path):
    schema = "src string, dst string, rel_type string, weight double, at timestamp_ntz, confidence double, amount double, duration long, night boolean, attr string, order long"
    rows = [("a", "b", "CALLED", 1.0, None, 0.5, None, 5, True, f"x{i}", i) for i in range(6)] + [("b", "c", "CALLED", 1.0, None, 0.7, None, 1, False, "y", 9)]
    folder, out, ck = (str(tmp_path / n) for n in ("obs", "edges", "ck"))
    for part in (rows[3:], rows[:2], rows[2:3]):  # the first observations come last
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        SE.stream_edges(spark.readStream.schema(schema).parquet(folder), out, ck).awaitTermination()
    from casegraph.operators.edges import accumulate

    want = sorted(map(str, accumulate(spark.createDataFrame(rows, schema)).collect()))
    batches = sorted(int(n[6:]) for n in os.listdir(out) if n.startswith("batch="))
    assert len(batches) == 3 and spark.read.parquet(f"{out}/batch={batches[-1]}").count() == 1  # only what the batch touches
    assert sorted(map(str, SE.current(spark, out).collect())) == want
    assert sorted(map(str, SE.current(spark, out, batches[0]).collect())) == sorted(map(str, accumulate(spark.createDataFrame(rows[3:], schema)).collect()))
    os.remove(f"{ck}/commits/{batches[-1]}")  # lost before it was committed: the batch runs again
    for n in os.listdir(f"{ck}/commits"):
        if n.startswith(f".{batches[-1]}."):
            os.remove(f"{ck}/commits/{n}")
    SE.stream_edges(spark.readStream.schema(schema).parquet(folder), out, ck).awaitTermination()
    assert sorted(map(str, SE.current(spark, out).collect())) == want
    SE.compact(spark, out, str(tmp_path / "compact"))
    assert sorted(map(str, SE.current(spark, str(tmp_path / "compact")).collect())) == want


def test_windowed_streams(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:20:00"), (2, "2024-01-01 05:00:00")], "u long, t string").select("u", F.to_timestamp("t").alias("ts"))
    assert sorted(r["n"] for r in SE.hourly(e).collect()) == [1, 2] and max(r["n"] for r in SE.sliding(e).collect()) == 3
    assert sorted(r["n"] for r in SE.sessions(e, "u").collect()) == [1, 2]


# --- extraction, resolution, search ---

NOTE = "accused Ravi Kumar met Amit Singh near Central Market. Shri Anil Verma is director of Blue Star Traders Ltd. Ravi Kumar, 34 using mobile 9876543210 in DL 01 AB 1234."


def test_mentions_keep_their_spans(spark):
    found = extract.mentions_in(NOTE, extract.Dictionary())
    assert all(NOTE[m["start"] : m["end"]].strip(" ,.") == m["text"] for m in found)
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:]))
    kinds = {(m["type"], m["text"]) for m in found}
    assert {("PERSON", "Ravi Kumar"), ("PERSON", "Amit Singh"), ("PERSON", "Anil Verma"), ("ORGANIZATION", "Blue Star Traders Ltd"), ("PHONE", "9876543210"), ("VEHICLE", "DL 01 AB 1234"), ("LOCATION", "Central Market")} <= kinds
    assert next(m for m in found if m.get("age"))["age"] == 34
    rel = {(r["src"], r["rel_type"], r["dst"]) for r in extract.relations_in(NOTE, found)}
    assert {("Ravi Kumar", "MET", "Amit Singh"), ("Anil Verma", "DIRECTOR_OF", "Blue Star Traders Ltd"), ("Ravi Kumar", "USES_PHONE", "9876543210")} <= rel
    known = extract.Dictionary(persons=("Xu Li",))
    assert {m["text"] for m in extract.mentions_in("then Xu Li ran", known)} == {"Xu Li"}
    df = spark.createDataFrame([(1, NOTE), (2, None), (3, "")], "doc_id long, text string")
    assert extract.mentions(df).count() == len(found) and extract.relations(df).count() == len(extract.relations_in(NOTE, found))


def test_chunks_cover_the_text():
    text = ("One sentence here. " * 300).strip()
    parts = extract.chunks(text, 500)
    assert "".join(p for _, p in parts) == text and all(text[a : a + len(p)] == p and len(p) <= 500 for a, p in parts)


def test_attribution_takes_the_person_before(spark):
    i = spark.createDataFrame([(1, "PAN", "X", 50), (1, "PAN", "Y", 2)], "doc_id long, kind string, value string, pos long")
    p = spark.createDataFrame([(1, "before", 40), (1, "nearer after", 52)], "doc_id long, text string, start long")
    assert {r["value"]: r["owner"] for r in extract.attributed(i, p).collect()} == {"X": "before", "Y": "before"}


def test_resolution(spark):
    e = spark.createDataFrame([(1, "ravi kumar singh", "a"), (2, "ravi k kumar singh", "a"), (3, "ravi kumar singh", "b"), (4, "rohit singh", "a")], "id long, key string, source string").withColumn("type", F.lit("PERSON"))
    got = {r["id"]: r["entity"] for r in resolve.fuzzy(e).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    m = spark.createDataFrame([("Bhola bhai", 1), ("Raja", 2)], "text string, n int")
    alias = spark.createDataFrame([("bhola", "p1"), ("raja", "p2"), ("raja", "p3")], "alias string, id string")
    assert {r["text"]: r["id"] for r in resolve.alias_resolved(m, alias).collect()} == {"Bhola bhai": "p1", "Raja": None}
    places = spark.createDataFrame([("1", "delhi"), ("2", "delhi old market"), ("3", "goa beach"), ("4", "goa")], "id string, key string")
    assert {r["id"]: r["parent"] for r in resolve.contained_places(places).collect()} == {"2": "1"}
    r = resolve.recall(spark.createDataFrame([("Ravi Kumar", "Mr Ravi Kumar"), ("Ravi Kumar", "Kumar Ravi"), ("A B", "X Y")], "a string, b string")).head()
    assert r["exact"] == pytest.approx(1 / 3) and r["fuzzy"] >= 1 / 3


def test_purge_cascades(spark):
    ents = spark.createDataFrame([("1", "PERSON", "unknown"), ("2", "PERSON", "Ravi Kumar")], "id string, type string, label string")
    e = spark.createDataFrame([("1", "2"), ("2", "3")], "src string, dst string")
    ev = spark.createDataFrame([("1",), ("2",)], "entity_id string")
    t = spark.createDataFrame([("a", ["1", "2"]), ("b", ["1"])], "id string, entity_ids array<string>")
    a, b, c, d = resolve.purge(ents, e, ev, t)
    assert a.count() == 1 and b.count() == 1 and c.count() == 1 and {r["id"]: r["entity_ids"] for r in d.collect()} == {"a": ["2"], "b": []}


def test_nearest(spark):
    v = spark.createDataFrame([(i, [float(i == j) + 0.01 * i for j in range(4)]) for i in range(4)], "vec_id long, embedding array<float>")
    rows = search.nearest(v, [(0, [1.0, 0, 0, 0])], 2).collect()
    assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"])][0] == 0


# --- dossiers ---


def test_masking_and_brief(spark):
    text = dossier.brief("Case", {"People": spark.createDataFrame([("Asha Rao was here",), (None,)], "note string")}, {"Asha Rao": "victim", "Asha": "witness"})
    assert "[VICTIM] was here" in text and "Asha" not in text and text.rstrip().split("Seal: ")[1] == ledger.digest(text.rsplit("\n\nSeal: ", 1)[0])


@pytest.mark.parametrize(("question", "want"), [("path between A and B", "path"), ("show money transfers", "money"), ("who is Ravi", "profile"), ("any alerts?", "alerts"), ("hello", "search"), ("top suspect", "key_players")])
def test_intents(question, want):
    assert dossier.intent(question) == want


def test_spotting():
    assert dossier.spotted('Did DL 01 AB 1234 or 9876543210 meet "the boss" and Ravi Kumar?') == ["DL 01 AB 1234", "9876543210", "the boss", "Ravi Kumar"]


# --- readers ---


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("call_id,caller,callee,timestamp,duration_sec,call_type,tower_location,imei\n1,9876543210,9876500000,2024-01-01 23:30:00,60,VOICE,Tower A,I1\n2,9876500000,9876543210,bad,5,SMS,,\n3,9876511111,9876500000,2024-01-02 10:00:00,5,SMS,Tower B,I1\n")
    rows = R.read(spark, "csv", str(tmp_path / "a.csv"))
    obs, events = R.cdr(rows)
    n = {r["rel_type"]: r["n"] for r in obs.groupBy("rel_type").agg(F.count("*").alias("n")).collect()}
    assert n == {"CALLED": 2, "PINGED_AT": 2, "SHARED_HANDSET": 1} and events.count() == 2 and R.quarantined(rows, "timestamp").count() == 1
    from casegraph.operators.edges import accumulate

    assert accumulate(obs).where("rel_type = 'CALLED'").agg(F.sum("night_count")).head()[0] == 1
    (tmp_path / "n.json").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    assert R.read(spark, "ndjson", str(tmp_path / "n.json")).where("id is not null").count() == 2
    (tmp_path / "f.json").write_text(json.dumps([{"fir_no": "1/24", "police_station": "PS", "date": "05/03/2024", "complainant": "Asha Rao", "accused": ["Ravi Kumar", "Amit Singh"], "text": "x"}]))
    docs, fir = R.firs(R.read(spark, "json", str(tmp_path / "f.json")))
    assert docs.count() == 1 and {r["rel_type"]: r["count"] for r in fir.groupBy("rel_type").count().collect()} == {"ACCUSED_IN": 2, "CO_ACCUSED": 1, "COMPLAINANT_IN": 1, "REGISTERED_AT": 1}
    (tmp_path / "r.xml").write_text("<rss><item><title><![CDATA[A & B]]></title><link>http://x</link><description>d <b>e</b></description></item></rss>")
    assert [(r["title"], r["description"], r["link"]) for r in R.read(spark, "rss", str(tmp_path / "r.xml")).collect()] == [("A & B", "d e", "http://x")]
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("nodes.csv", "# index,name\n1,a\n2,b\n")
    assert sorted(r["row"]["name"] for r in R.read(spark, "zip_csv", str(tmp_path / "z.zip")).collect()) == ["a", "b"]
    good, bad = R.harvest(spark, [("csv", str(tmp_path / "a.csv")), ("parquet", str(tmp_path / "none")), ("nope", "x")])
    assert len(good) == 1 and [n for n, _ in bad] == ["parquet", "nope"]


def test_html_names_and_parties(spark):
    p = spark.createDataFrame([(1, '<img src="x" alt="Ravi Kumar"><table><tr><td>Amit Singh</td><td>x</td></tr></table><p>The wanted person is Anil Verma today</p>')], "page_id long, html string")
    assert {(r["name"], r["how"]) for r in R.html_names(p).collect()} == {("Ravi Kumar", "image"), ("Amit Singh", "table"), ("Anil Verma", "prose")}
    r = spark.range(1).select(R.court_parties(F.lit("Ravi Kumar and others v. State of X")).alias("p")).head()["p"]
    assert (r["plaintiff"], r["defendant"]) == ("Ravi Kumar", "State of X")
    link = '<a href="https://www.a.com/1">A</a><a href="https://a.com/2">B</a><a href="https://b.org/x">C</a>'
    got = R.search_results(spark.createDataFrame([(link,)], "html string"), preferred=("b.org",)).collect()
    assert [r["url"] for r in got] == ["https://b.org/x", "https://www.a.com/1"]
