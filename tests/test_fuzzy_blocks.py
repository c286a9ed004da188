"""fuzzy_block_match: rows of the SQL for copies, near names, blocks and nulls; distances are taken once a pair of names."""

import duckdb

from casegraph.queries import ORACLE, QUERIES

NAMES = ["large ring", "large rings", "Large ring", "large wing", "large bolt", None, "small ring"]


def test_copies_of_a_name_are_compared_once(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table part (p_partkey bigint, p_name varchar, p_brand varchar)")
    rows = [(7 * i % 210, NAMES[i % 7], ["x", "y", None][i // 7 % 3]) for i in range(210)]
    con.executemany("insert into part values (?, ?, ?)", rows)
    con.execute(f"copy part to '{tmp_path}/part.parquet'")
    df = QUERIES["fuzzy_block_match"](spark, str(tmp_path))
    want = con.execute(ORACLE["fuzzy_block_match"]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and {d for *_, d in want} == {0, 1, 2}
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    at = plan.index("levenshtein")
    assert "p_partkey" not in plan[at:].split("relation")[0] and "aggregate" in plan[at:].split("relation")[0]
