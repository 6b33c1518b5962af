"""Guards on physical plans: the properties that matter at scale."""

import re

import pytest

from ledgerline.plans.registry import PLANS, load_all

load_all()


def _plan(spark, sf, name):
    return PLANS[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def big_tables(spark):
    """The joins that tables too big to broadcast get."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_no_cross_join_no_python_and_a_given_table(spark, sf, name, big_tables):
    plan = _plan(spark, sf, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    # Every query reads a given table; some write first and read back what they wrote.
    assert "FileScan" in plan or "Scan parquet" in plan or "Scan json" in plan or name == "sink_skipped", name


def test_wildcard_free_rules_are_equi_joined(spark, sf, big_tables):
    plan = _plan(spark, sf, "role_delta")
    assert len(re.findall("Exchange hashpartitioning", plan)) <= 55


def test_hot_key_counts_leave_the_join_before_they_are_summed(spark, sf, big_tables):
    """An exchange on (key, column, value) lies between the salted row join and the sum."""
    plan = _plan(spark, sf, "tieout_hot_key_summary")
    assert re.search(r"Exchange hashpartitioning\(__tie_k0#\d+L?, __tie_i#\d+, __tie_c0", plan)
    assert re.search(r"Exchange hashpartitioning\(__tie_k0#\d+L?, __tie_salt", plan)


def test_snapshot_content_is_one_grouped_pass(spark, sf, big_tables):
    assert len(re.findall("Exchange hashpartitioning", _plan(spark, sf, "snapshot_content"))) <= 10


def test_key_profile_reads_only_key_columns(spark, sf):
    plan = _plan(spark, sf, "tieout_overview")
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln]
    assert scans and all("o_orderkey" in ln and "o_custkey" not in ln and "o_orderstatus" not in ln
                         for ln in scans)


def test_a_scope_does_not_deal_objects_by_schema(spark, sf, big_tables):
    """One schema's objects would lie in one task."""
    plan = _plan(spark, sf, "snapshot_scope")
    assert "LeftSemi" in plan and not re.search("SortMergeJoin .*LeftSemi", plan)


def test_objects_are_not_dealt_by_type(spark, sf, big_tables):
    """Nearly all objects of a privilege model are schemas."""
    plan = _plan(spark, sf, "model_audit")
    assert not re.search(r"SortMergeJoin \[obj_type#\d+\], \[obj_type#\d+\], Inner", plan)


def test_audit_exchanges_before_it_groups(spark, sf, big_tables):
    """Read from above: the grouping's exchange lies below both of its steps."""
    plan = [ln.split("(")[0].strip(" :+-*") for ln in _plan(spark, sf, "model_audit").splitlines()]
    plan = [ln for ln in plan if ln in ("HashAggregate", "SortAggregate", "Exchange hashpartitioning", "Union")]
    assert plan[:4] == ["HashAggregate", "HashAggregate", "Exchange hashpartitioning", "Union"], plan
