"""Every registered query runs; those with SQL give the rows that DuckDB gives."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from casegraph.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    assert not isinstance(v, decimal.Decimal), "decimals do not compare with doubles"
    return v if not isinstance(v, datetime.datetime) else v.isoformat()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_match(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_others_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_works_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for n in ("casegraph", "__spark_entry__.py", *(["corpus_pipeline.py"] if os.path.exists(f"{root}/corpus_pipeline.py") else [])):
        (shutil.copytree if os.path.isdir(f"{root}/{n}") else shutil.copy)(f"{root}/{n}", tmp_path / n)
    shutil.rmtree(tmp_path / "casegraph/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}).returncode == 0
