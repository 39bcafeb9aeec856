"""Physical-plan checks over every registered query (scale properties).

- no Python evaluation on the data path,
- no cartesian or nested-loop join,
- every grouping shuffle has a partial aggregation in front of it.
"""

import re

import pytest

from conftest import SF_SMALL

from logweave.plans import all_queries

QUERIES = all_queries()
GROUPING = ["r1_reconcile", "r2_reconcile_mismatch", "a1_token_count", "a3_json_key_counter", "a4_grouped_values",
            "a5_duplicate_groups", "t2_window_token_counts", "u3_union_distinct", "n7_loose_typing",
            "w6_field_value_counts", "a2_group_keys_not_selected", "m1_column_profile", "j5_semi_join"]


def _plan(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_join(spark, name):
    plan = _plan(spark, name)
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name}: {bad}"


@pytest.mark.parametrize("name", GROUPING)
def test_partial_aggregation_before_shuffle(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.collect()  # final adaptive plan
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"partial_|HashAggregate\(keys=\[[^\]]*\], functions=\[\]", plan), plan


def _formatted(df):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_filters_reach_the_scan(spark):
    plan = _formatted(QUERIES["f4_optional_filters"](spark, SF_SMALL))
    pushed = [l for l in plan.splitlines() if l.startswith("PushedFilters")]
    assert pushed and "EqualTo(o_orderstatus,F)" in pushed[0] and "StringStartsWith(o_orderpriority,1-)" in pushed[0]


def test_scans_read_only_needed_columns(spark):
    plan = _formatted(QUERIES["w1_request_records"](spark, SF_SMALL))
    schema = [l for l in plan.splitlines() if l.startswith("ReadSchema")][0]
    assert "value" not in schema and "props" in schema   # 5 of the 6 events columns
    plan = _formatted(QUERIES["o1_top_k"](spark, SF_SMALL))
    schema = [l for l in plan.splitlines() if l.startswith("ReadSchema")][0]
    fields = schema.split("struct<", 1)[1].rstrip(">").split(",")
    assert [f.split(":")[0] for f in fields] == ["l_orderkey", "l_linenumber", "l_extendedprice", "l_tax"]


def test_good_requests_pick_the_token_once(spark):
    """W8's family renders the line and picks the token as often as W1 does:
    no second copy in a pushed filter (its own `ds` adds one date_format)."""
    w1 = _plan(spark, "w1_request_records")
    for name, extra in (("w8_partition_layout", 1), ("h3_pseudonymised_records", 0)):
        plan = _plan(spark, name)
        assert plan.count("date_format") <= w1.count("date_format") + extra, name
        assert "substring_index" not in plan or plan.count("substring_index") <= w1.count("substring_index"), name


def test_json_is_parsed_twice_for_all_getters(spark):
    for name in ("n1_strict_get", "n2_lenient_get"):
        plan = _plan(spark, name)
        assert plan.count("parseJson") + plan.count("try_parse_json") <= 2, name
        assert plan.count("from_json") <= 2 and plan.count("get_json_object") <= 3, name


def test_insert_is_rebalanced(spark):
    """The plan that writes a partition insert spreads a hot day over tasks."""
    from logweave.plans.web import good_records
    from logweave.operators import weblog

    rows = weblog.partition_layout(good_records(spark, SF_SMALL), "20240101").hint("rebalance", "ds")
    assert "REBALANCE" in rows._jdf.queryExecution().executedPlan().toString()
