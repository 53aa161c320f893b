"""Queries that must not run Python, and plans without products of rows."""

import pytest

from tallyforge.llm import registry

AT = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_product_of_rows(spark, name):
    found = plan(registry.QUERIES[name](spark, AT))
    assert "CartesianProduct" not in found and "NestedLoop" not in found
    if name in ("op1_license_scan", "op7_chat_rotation"):
        assert not any(x in found for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))
