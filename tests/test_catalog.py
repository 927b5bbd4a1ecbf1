"""Every query of the catalogue against its SQL, as the driver does it, on the smallest tables."""

import math

import duckdb
import pytest

from loomframe import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(catalog.SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


def test_flagship_is_sorted(spark):
    rows = [(r.l_returnflag, r.l_linestatus) for r in catalog.flagship(spark, SF).collect()]
    assert rows == sorted(rows) and rows


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["query_arith_in"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(l_linenumber" in plan and "l_extendedprice" not in plan


def test_groups_are_combined_before_the_shuffle(spark):
    plan = catalog.QUERIES["gb_agglist"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "SinglePartition" not in plan
