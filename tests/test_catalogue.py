"""Every query of the catalogue against its SQL in DuckDB, and plans that scan no more than they need."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessera import catalogue
from tessera.functions.ring import Ring
from tessera.operators.predicate import compare
from tessera.sources.tables import table

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def shown(rows, order):
    return sorted(tuple("nan" if isinstance(r[i], float) and math.isnan(r[i]) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    result = con.execute(catalogue.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    assert shown(df.collect(), [df.columns.index(c) for c in names]) == shown(result.fetchall(), [columns.index(c) for c in names])


def test_every_query_of_the_catalogue_has_sql():
    assert catalogue.QUERIES.keys() == catalogue.SQL.keys()
    assert catalogue.QUERIES.items() <= __spark_entry__.queries().items() and catalogue.SQL.items() <= __spark_entry__.oracle_sql().items()


def test_ring_places_every_customer(spark):
    rows = catalogue.QUERIES["hash_ring"](spark, str(DATA)).collect()
    ring = Ring("n1", "n2", "n3", "n4")
    assert all(r["node"] == ring.get(str(r["c_custkey"])) for r in rows)
    assert len(rows) == table(spark, str(DATA), "customer").count() and {r["node"] for r in rows} == {"n1", "n2", "n3", "n4"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(table(spark, str(DATA), "orders").filter(compare("o_orderkey", "=", 42)).select("o_orderkey"))
    assert "EqualTo(o_orderkey,42)" in text and "ReadSchema: struct<o_orderkey:bigint>" in text


@pytest.mark.parametrize(
    ("name", "operator"),
    [("join_sort_merge", "SortMergeJoin"), ("join_nested_loop_theta", "BroadcastNestedLoopJoin"), ("sort_multi_limit", "TakeOrderedAndProject"), ("agg_group_sum", "partial_sum")],
)
def test_physical_operators(spark, name, operator):
    assert operator in plan(catalogue.QUERIES[name](spark, str(DATA)))
