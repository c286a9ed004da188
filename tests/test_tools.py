import pytest
from pyspark.sql import functions as F

from casegraph.operators.edges import accumulate
from casegraph.plans import dossier, outliers, tools
from casegraph.sources import readers, structured


@pytest.fixture(scope="module")
def case(spark):
    ents = spark.createDataFrame([("a", "PERSON", "Ravi Kumar", "ravi kumar", 3), ("b", "PERSON", "Amit Singh", "amit singh", 1), ("c", "ORGANIZATION", "Blue Star", "blue star", 1)], "id string, type string, label string, canonical_key string, mention_count int")
    e = spark.createDataFrame([("a", "b", "MET", 2.0, None), ("b", "c", "TRANSFERRED_TO", 1.0, 500.0)], "src string, dst string, rel_type string, weight double, total_amount double")
    ev = spark.createDataFrame([("e1", "CALL", "2024-01-01", ["a"])], "id string, kind string, t string, entity_ids array<string>").withColumn("occurred_at", F.col("t").cast("timestamp_ntz"))
    al = spark.createDataFrame([("x", "k", "high", "T", 0.7, ["a"], "pending")], "id string, kind string, severity string, title string, score double, entity_ids array<string>, review_status string")
    evid = spark.createDataFrame([("v", "d", "a", 0.9)], "id string, document_id string, entity_id string, confidence double")
    docs = spark.createDataFrame([("d", "Note", "Ravi was seen")], "id string, title string, content string")
    return dossier.Case(ents, e, ev, al, evid, docs)


def test_every_tool_runs(case):
    arguments = {"search_entities": {"text": "ravi"}, "entity_profile": {"entity": "a"}, "find_path": {"source": "a", "target": "c"}, "neighbours": {"entity": "a"}, "money_flow": {"entity": "b"}, "entity_timeline": {"entity": "a"}, "list_alerts": {}, "aggregate": {"dataset": "events", "group_by": "month"}, "search_documents": {"text": "seen"}, "read_document": {"document": "d"}, "network_overview": {}}
    assert set(arguments) == set(tools.TOOLS)
    for name, a in arguments.items():
        assert tools.call(name, case, **a).count() >= 1, name
    with pytest.raises(ValueError):
        tools.call("nope", case)
    with pytest.raises(ValueError):
        tools.call("list_alerts", case, wrong=1)


def test_unreviewed_labels_are_held_back(case):
    assert {r["id"]: r["label"] for r in tools.held_back(case.entities, case.alerts).collect()}["a"] == "Pending analyst review"
    done = tools.patched(case.alerts, case.alerts.select("id", F.lit("reviewed").alias("review_status")))
    assert {r["id"]: r["label"] for r in tools.held_back(case.entities, done).collect()}["a"] == "Ravi Kumar"


def test_provenance_line(spark):
    r = spark.range(1).select(tools.provenance(F.lit("FIR"), F.lit("https://www.example.org/x"), F.lit(" 1/24 ")).alias("p"), tools.provenance(F.lit("GAZETTE_ENTRY"), F.lit(None).cast("string"), F.lit("")).alias("q")).head()
    assert r["p"] == "First information report - 1/24 - example.org" and r["q"] == "Gazette Entry"


def test_structured_case_reloads_alike(spark, tmp_path):
    (tmp_path / "01_entities_nodes.csv").write_text("entity_id,entity_type,name,alias,age,role_in_network,sub_network,location_city,location_state,status,risk_flag,notes\nP1,person,Ravi Kumar,Bhola,34,leader,n,Delhi,DL,active,,\nA1,bank_account,001234567,,,,,,,,,\nP2,person,Amit Singh,,,,,,,,,\n")
    (tmp_path / "02_relationships_edges.csv").write_text("source_id,target_id,relationship_type,weight,detected_date,evidence_source,sub_network,description\nP1,A1,controls,2,05/03/2024,x,n,\nP1,P2,recruited,,2024-01-01,x,n,\nP1,ZZ,met,1,,,,\n")
    (tmp_path / "04_ncrp_complaints.csv").write_text("complaint_id,filing_date,complainant_name,complainant_city,complainant_state,amount_defrauded_inr,modus_operandi,linked_account,linked_account_holder,police_station,investigation_status,notes\nC1,01/02/2024,X,Pune,MH,5000,otp,A1,,PS,open,\n")
    one, two = structured.load(spark, str(tmp_path)), structured.load(spark, str(tmp_path))
    assert sorted(map(str, one["entities"].collect())) == sorted(map(str, two["entities"].collect()))
    ids = {r["record_id"]: r["id"] for r in one["entities"].collect()}
    assert {(r["src"], r["rel_type"], r["dst"]) for r in one["relationships"].collect()} == {(ids["P1"], "OWNS_ACCOUNT", ids["A1"]), (ids["P2"], "REPORTS_TO", ids["P1"])}
    assert one["events"].count() == 1 and "documents" not in one


def test_planted_patterns_are_found(spark):
    from casegraph.functions import keys as K
    from casegraph.plans import detectors as D

    s = structured.synthetic(spark)
    obs, _ = readers.cdr(s["cdr"])
    assert accumulate(obs).where("rel_type = 'SHARED_HANDSET'").count() > 0
    truth = {r["pattern"]: r for r in s["truth"].collect()}
    known = s["kyc"].select(F.col("msisdn").alias("caller"))
    calls = s["cdr"].join(known, "caller", "left_anti").select(F.col("caller").alias("phone"), K.parsed_time(F.col("timestamp")).alias("ts"))
    assert [r["phone"] for r in D.burners(calls).collect()] == [truth["burner_phone"]["subject"]]
    t = s["transactions"].select("txn_id", F.col("to_account").alias("account"), K.parsed_time(F.col("timestamp")).alias("ts"), F.col("amount_inr").cast("double").alias("amount"), F.col("from_account"))
    out = t.select(F.col("from_account").alias("account"), "ts", F.col("amount").alias("value"))
    hit = D.structuring(t, out).collect()
    assert [r["account"] for r in hit] == [truth["structuring"]["subject"]] and hit[0]["onward"] == 220000.0


def test_outliers_stand_out(spark):
    rows = [(i, float(10 + i % 5), float(3 + i % 3)) for i in range(60)] + [(99, 5000.0, 900.0)]
    o = outliers.outliers(spark.createDataFrame(rows, "id long, calls double, cases double"), "id", ("calls", "cases"))
    got = {r["id"]: r for r in o.collect()}
    assert got[99]["both"] and got[99]["score"] == max(r["score"] for r in got.values())
    assert outliers.outliers(spark.createDataFrame(rows[:5], "id long, calls double, cases double"), "id", ("calls", "cases")).collect() == []


def test_labels_make_the_columns(spark):
    from casegraph.plans.tools import register_functions

    register_functions(spark)
    rows = [(1, "A knife, two Knives and a pistol."), (1, "the station"), (2, None), (2, "pistols"), (None, "knife knife")]
    spark.createDataFrame(rows, "k long, note string").createOrReplaceTempView("notes_by_key")
    call = "select * from labelled(table(notes_by_key) partition by k, text => 'note', labels => '{}')"
    got = spark.sql(call.format("WEAPON: knife, pistol; PLACE: station"))
    assert got.columns == ["k", "rows", "WEAPON", "PLACE"] and sorted(map(tuple, got.collect()), key=str) == sorted([(1, 2, 2, 1), (2, 2, 0, 0), (None, 1, 2, 0)], key=str)
    assert spark.sql(call.format("X: a.b, two")).columns == ["k", "rows", "X"]
    for bad in ("", "rows: x", "K: x", "NAME"):
        with pytest.raises(Exception, match="each label has a name"):
            spark.sql(call.format(bad)).collect()
    with pytest.raises(Exception, match="no column"):
        spark.sql("select * from labelled(table(notes_by_key) partition by k, text => 'nothing', labels => 'A: b')").collect()
