"""Every query of the catalogue against its SQL, on the smallest scale."""

import math
import os

import duckdb
import pytest

from tallyforge.plans import catalogue

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(AT):
        con.execute(f"create view {f.split('.')[0]} as select * from '{AT}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def test_each_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    ours = catalogue.QUERIES[name](spark, AT)
    cursor = oracle.execute(catalogue.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(ours.columns) == sorted(columns)
    order = sorted(columns)
    theirs = sorted([[plain(row[columns.index(c)]) for c in order] for row in cursor.fetchall()], key=str)
    mine = sorted([[plain(row[c]) for c in order] for row in ours.collect()], key=str)
    assert mine == theirs
    assert mine, "an empty result shows nothing"
