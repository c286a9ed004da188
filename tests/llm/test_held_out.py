"""Held-out accuracy of the trained models on the synthetic documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegraph.llm import quality
from casegraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").where("lang is not null")
    n, right, und = QUERIES["op6_langid"](spark, sf).where("held_out").join(truth, "doc_id").agg(F.count("*"), F.count_if(F.col("lang_pred") == F.col("lang")), F.count_if(F.col("lang_pred") == "und")).head()
    assert n > 200 and right >= 0.98 * n and und == 0


def test_grades_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    grades = quality.grades(spark.read.parquet(f"{SF}/labels.parquet"))
    fold = F.pmod(F.xxhash64(F.md5("text")), F.lit(4))  # copies of a text are in one fold
    model = quality.fit(docs.where(fold != 0), grades, 3)
    assert model.thresholds[0] <= model.thresholds[1]
    rows = quality.rated(docs.where(fold == 0).join(grades, "doc_id").where("grade is not null"), model).select("grade", "expected_grade", "selected").toPandas()
    table = np.zeros((3, 2), int)
    np.add.at(table, (rows["grade"].to_numpy(), rows["selected"].to_numpy().astype(int)), 1)
    assert table.sum() > 500
    assert table[2, 1] >= 0.97 * table[2].sum(), table  # clean documents stay
    assert table[:2, 0].sum() >= 0.9 * table[:2].sum(), table  # poor and toxic ones go
    means = rows.groupby("grade")["expected_grade"].mean()
    assert means[0] < means[1] < means[2]
