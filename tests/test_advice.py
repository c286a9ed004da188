"""Places where a query once did less than the whole job."""

import pytest

from casegraph.plans import search


def test_case_linkage_reads_all_documents_and_narratives(spark, tmp_path):
    from casegraph.queries import QUERIES

    texts = ["idiot license red lorry crossed silver bridge"] * 2 + ["green parrots sing songs", "idiot license kept"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["case_linkage"](spark, str(tmp_path)).collect())
    assert got[0] == (0, 1, 0.8, True) and [r[:2] for r in got[1:]] == [(0, 3), (1, 3)] and all(0.55 <= r[2] < 0.8 for r in got[1:])
    assert [(r["size"], r["common_signature"]) for r in QUERIES["case_series"](spark, str(tmp_path)).collect()] == [(3, "insult,licence")]


def test_screening_scores_all_names(spark):
    from casegraph.plans import resolve

    a = spark.createDataFrame([(1, "PERSON", "Lee Kim Sun"), (2, "PERSON", "Mohamed Salahudin"), (3, "ORGANIZATION", "Blue Star Traders")], "id long, type string, label string")
    w = spark.createDataFrame([("L1", "PERSON", "Lee Kim Sun"), ("L2", "PERSON", "Mohammad Salahuddin"), ("L3", "PERSON", "Blue Star Traders")], "id string, type string, name string")
    assert {(r["id"], r["list_id"]) for r in resolve.screened(a, w).collect()} == {(1, "L1"), (2, "L2"), (3, "L3")}


def test_tfidf_terms_keeps_6000_terms(spark, tmp_path):
    from casegraph.queries import QUERIES

    rows = [(d, " ".join(f"t{d}x{i}" for i in range(40))) for d in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["tfidf_terms"](spark, str(tmp_path)).select("term").distinct().count() == 6000
