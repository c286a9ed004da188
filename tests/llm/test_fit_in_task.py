"""The quality model is fitted in a task: the driver holds neither the sample nor its features."""

import os

import numpy as np

from casegraph.llm import quality


def test_the_driver_does_not_fit(spark, sf, monkeypatch):
    docs, ratings = spark.read.parquet(f"{sf}/documents.parquet"), quality.grades(spark.read.parquet(f"{sf}/labels.parquet"))
    rated = docs.join(ratings, "doc_id").where("grade is not null").orderBy("doc_id", "grade").collect()
    first = list({r["text"]: r for r in reversed(rated)}.values())[::-1]
    of = np.array([r["grade"] for r in first])
    counts = [sum(r["grade"] == j for r in rated) for j in range(3)]
    want = quality.fit_rows([r["text"] for r in first], of, 3, [counts[j] / max((of == j).sum(), 1) for j in range(3)])
    driver, real = os.getpid(), quality.fit_rows

    def outside(*args, **options):
        assert os.getpid() != driver
        return real(*args, **options)

    monkeypatch.setattr(quality, "fit_rows", outside)
    got = quality.fit(docs, ratings, 3)
    assert (got.weights == want.weights).all() and (got.thresholds == want.thresholds).all() and got.weights.any()


def test_rated_documents_that_are_not_there(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(1, 0), (2, 2)], "doc_id long, grade int"), 3)
    assert not model.weights.any() and len(model.thresholds) == 2
