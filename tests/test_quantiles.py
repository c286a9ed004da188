import random

import numpy as np
import pytest

from casegraph.operators import relational as R

SHARES = {"q0": 0.0, "q30": 0.3, "q50": 0.5, "q90": 0.9, "q100": 1.0}


def test_quantiles_are_those_of_numpy(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None, "hot", "hot", "hot"]), rnd.choice([None, 1.5, 2.0, rnd.gauss(0, 9)])) for _ in range(900)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in R.quantiles(df, ["k"], "v", SHARES).collect()}
    assert set(got) == {"a", "b", None, "hot", "one"}
    for k, r in got.items():
        values = [v for x, v in rows if x == k and v is not None]
        assert [r[n] for n in SHARES] == pytest.approx(list(np.quantile(values, list(SHARES.values()))), abs=1e-12)
    whole = R.quantiles(df, [], "v", SHARES).head()
    assert list(whole) == pytest.approx(list(np.quantile([v for _, v in rows if v is not None], list(SHARES.values()))), abs=1e-12)


def test_robust_keeps_null_groups_and_groups_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (None, 8.0), ("e", None)], "k string, v double")
    got = {r["k"]: r for r in R.robust(df, ["k"], "v").collect()}
    assert (got[None]["median"], got[None]["mad"], got[None]["p90"]) == (3.0, 2.0, pytest.approx(7.0))
    assert list(got["e"])[1:] == [None] * 5


def test_column_quantiles_of_nothing_are_null(spark):
    df = spark.createDataFrame([], "a long, b double")
    assert list(R.column_quantiles(df, {"x": ("a", 0.5), "y": ("b", 0.9)}).head()) == [None, None]
    some = spark.createDataFrame([(1, None), (2, None), (4, None)], "a long, b double")
    assert list(R.column_quantiles(some, {"x": ("a", 0.5), "y": ("b", 0.9), "z": ("a", 0.75)}).head()) == [2.0, None, 3.0]
