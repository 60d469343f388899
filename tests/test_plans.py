"""Plans that queries should have: pruned scans, pushed filters, limits before shuffles."""

import re

import pytest

from graphmill import queries as core


def plan(spark, sf, name):
    return core.QUERIES[name](spark, sf)._jdf.queryExecution().toString()


def test_a_kind_reads_one_table_and_pushes_its_filter(spark, sf):
    text = plan(spark, sf, "nodes_filter").split("== Physical Plan ==")[1]
    assert text.count("FileScan parquet") == 1 and "GreaterThanOrEqual(p_size,45)" in text and "ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string,p_size:int>" in text


def test_edge_kinds_prune_the_branches_of_the_union(spark, sf):
    text = plan(spark, sf, "hop1_kinds").split("== Physical Plan ==")[1]
    assert "lineitem.parquet" not in text


def test_first_calls_are_limited_before_the_shuffle(spark, sf):
    assert plan(spark, sf, "opening_sessions").split("== Physical Plan ==")[1].count("WindowGroupLimit") == 2


def test_top_k_is_no_global_sort(spark, sf):
    assert "TakeOrderedAndProject" in plan(spark, sf, "hotspots")


@pytest.mark.parametrize("name", sorted(n for n in core.SQL if not n.startswith(("html_", "extract_"))))
def test_no_python_but_where_sources_are_parsed(spark, sf, name):
    text = plan(spark, sf, name)
    assert not re.search("EvalPython|MapIn(Arrow|Pandas)|PythonUDF|CartesianProduct", text)
