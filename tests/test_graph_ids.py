"""Graph queries where part numbers reach those of suppliers (1,000,000 on) against DuckDB."""

import duckdb
import pytest

from lumenquarry.plans.catalog import QUERIES, SQL

LINES = [(1, 1000001), (1, 7), (2, 1000001), (20, 1000020), (20, 7), (3, 1000020), (40, 1000003), (3, 1000040), (5, 20), (5, 9), (60, 9)]


@pytest.mark.parametrize("name", ["graph_common_neighbors", "graph_metrics", "removed_node_edges"])
def test_shared_ids(spark, tmp_path, name):
    con = duckdb.connect()
    tables = {"lineitem": (LINES, "l_suppkey long, l_partkey long"), "part": ([(x,) for x in sorted({p for _, p in LINES})], "p_partkey long"), "supplier": ([(x,) for x in sorted({s for s, _ in LINES})], "s_suppkey long")}
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({SQL[name]})").fetchall()
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(want)


def test_related_by_classes(spark, tmp_path):
    """Null keys, repeated ids and many members of a class; no pair is formed once for every key that it shares."""
    rows = [(i, i % 3 if i % 7 else None, "AB"[i % 2] if i % 5 else None) for i in range(120)] + [(20, 1, "A"), (40, 1, "B"), (None, 1, "A")]
    con = duckdb.connect()
    for name, part in (("odd", rows), ("plain", rows[:120])):
        spark.createDataFrame(part, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/{name}/customer.parquet")
        con.execute(f"create or replace view customer as select * from read_parquet('{tmp_path}/{name}/customer.parquet/*.parquet')")
        df = QUERIES["graph_related_weighted"](spark, f"{tmp_path}/{name}")
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(SQL["graph_related_weighted"]).fetchall())
    assert df._jdf.queryExecution().optimizedPlan().toString().split("\n")[0].startswith("Project")  # nothing is summed over pairs
