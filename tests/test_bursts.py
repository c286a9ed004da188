"""burst_suppressed against its SQL where no hour stands out, and where some do."""

import duckdb
import pytest

from casegraph.queries import ORACLE, QUERIES


@pytest.mark.parametrize("counts, bursts", [([8] * 40, [None]), ([1, 1, 1, 1, 1, 1, 1, 1, 1, 9, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1], None), ([], [None])])
def test_bursts_are_those_of_the_sql(spark, tmp_path, counts, bursts):
    con = duckdb.connect()
    hours = [10 * h for h, n in enumerate(counts) for _ in range(n)]  # each window holds one hour
    con.execute("create table events as select timestamp '2024-01-01' + to_hours(h) ts from (select unnest(?::int[]) h)", [hours])
    con.execute(f"copy events to '{tmp_path}/events.parquet'")
    got = [r[0] for r in QUERIES["burst_suppressed"](spark, str(tmp_path)).collect()]
    want = [r[0] for r in con.execute(ORACLE["burst_suppressed"]).fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bursts is None or got == bursts
