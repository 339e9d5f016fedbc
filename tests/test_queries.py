"""Every registered query against its SQL at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def normal(table):
    frame = table.to_pandas(types_mapper=pd.ArrowDtype)
    clean = lambda v: None if v is None or v is pd.NA or v != v else v
    columns = sorted(frame.columns)
    return columns, sorted((tuple(clean(v) for v in r) for r in frame[columns].itertuples(index=False)), key=lambda t: tuple(map(repr, t)))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_queries_without_sql_are_optional_ones():
    """Only operators that SQL cannot express, all of the optional part, may lack it."""
    assert set(SQL) <= set(QUERIES)
    assert all(name == "pipeline" or name.startswith("op") for name in set(QUERIES) - set(SQL))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toArrow()
    want = con.sql(SQL[name]).to_arrow_table()
    assert normal(got) == normal(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_dependencies_both_ways_are_followed_to_their_ends(spark):
    hops = {r["direction"]: r["hop"] for r in QUERIES["deps_both"](spark, SF).groupBy("direction").agg({"hop": "max"}).withColumnRenamed("max(hop)", "hop").collect()}
    assert set(hops) == {"forward", "reverse"} and min(hops.values()) > 3


def test_entry(spark):
    assert entry.entry(spark).columns == ["token", "hits", "files"]
