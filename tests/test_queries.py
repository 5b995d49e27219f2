"""Every query against DuckDB on the same tables; those that SQL can't express, by their rows."""

import duckdb
import pytest

from veldt.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    found = duck.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert len(duck.description) == len(cols)
    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(found)


def test_entry_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["i", "y"] and df.count() > 0


def test_plan_reads_two_columns_of_a_table(spark, sf):
    plan = QUERIES["spmv_order_part"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
