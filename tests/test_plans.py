"""What physical plans must and must not have."""

import pytest

from tallyforge.plans import catalogue

AT = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_product_of_rows(spark, name):
    found = plan(catalogue.QUERIES[name](spark, AT))
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found


def test_scans_read_what_is_asked(spark):
    found = plan(catalogue.QUERIES["usage_stats"](spark, AT))
    assert "ReadSchema: struct<n_chars:bigint>" in found
    assert "text" not in plan(catalogue.QUERIES["split_80_10_10"](spark, AT))


def test_filters_reach_the_scan(spark):
    assert "EqualTo(role,user)" in plan(catalogue.QUERIES["chatml_prompt"](spark, AT))


PYTHON = {"repetition_penalty", "tokenizer_counts", "remote_map", "remote_outcomes", "sampled_generation", "symbolic_cascade", "token_ids"}  # callables that the caller brings
PYTHON |= {"arrow_documents", "arrow_folder_scan", "csv_documents", "csv_round_trip", "csv_strings_scan", "json_array_documents", "json_array_scan", "load_of_lists"}  # readers


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - PYTHON))
def test_python_runs_only_where_it_must(spark, name):
    found = plan(catalogue.QUERIES[name](spark, AT))
    assert not any(x in found for x in ("EvalPython", "InPandas", "InArrow"))


@pytest.mark.parametrize("name", ["pass_rate", "pass_rate_boxed"])
def test_sums_are_made_before_the_shuffle(spark, name):
    assert "partial_sum" in plan(catalogue.QUERIES[name](spark, AT))
