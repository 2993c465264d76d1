"""Plans are the ones meant: columns pruned, filters pushed, no nested loops and no Python in hot paths."""

import re

import pytest

from tracewell.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, columns", [("a3_cosine_pairs", {"lang", "text"}), ("q1_literal_carryover", {"source", "text"}), ("a5_overlap_shingles", {"source", "text"})])
def test_scans_read_only_what_is_asked(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(registry.QUERIES[name](spark, SF)))
    assert read and all({c.split(":")[0] for c in r.split(",")} <= columns for r in read)


def test_filters_reach_the_scan(spark):
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan(registry.QUERIES["q27_callers"](spark, SF))


@pytest.mark.parametrize("name", ["j5_naive_match", "j6_strict_match", "q17_method_trace", "q18_gate_sweep"])
def test_gates_are_hash_or_merge_joins(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", sorted(n for n in registry.ORACLE_SQL if not n.startswith(("g6", "g7", "a28", "q3", "g5", "a22"))))
def test_queries_with_sql_run_without_python(spark, name):
    assert not re.search(r"Python|Pandas|Arrow", plan(registry.QUERIES[name](spark, SF)))
