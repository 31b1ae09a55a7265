"""Plans that must keep their shape: pushdown, join types, no Python in hot paths."""

import pytest

from curatorium.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "score_tier", "tier_shift", "norm_name", "dup_leader", "merge_facts", "slot_fill", "set_visible", "shared_items", "taste_match",
    "kpi_row", "earned_badges", "point_in_polygon", "daily_quota", "repeat_ledger", "running_best", "entity_regex", "stack_top"])
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text
    assert "Python" not in text and "Pandas" not in text


@pytest.mark.parametrize("name", ["daily_quota", "repeat_ledger", "compact_ranks", "milestones"])
def test_groups_are_limited_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scoring_never_shuffles_and_prunes_columns(spark):
    text = plan(spark, "score_tier")
    assert "Exchange hashpartitioning" not in text
    assert "ReadSchema" in text and "p_retailprice" not in text and "p_name" not in text


def test_filters_reach_the_scan(spark):
    assert "EqualTo(event_type,click)" in plan(spark, "canonical_edges")


def test_slot_rules_are_one_hash_join(spark):
    text = plan(spark, "slot_fill")
    assert "rule_key" in text and text.count("BroadcastHashJoin [rule_key") == 1


def test_broadcast_needs_a_bound(spark):
    from curatorium.operators.bounded import small_or_shuffled

    many = spark.range(100)
    hinted = small_or_shuffled(many, 100)._jdf.queryExecution().analyzed().toString()
    plain = small_or_shuffled(many, 99)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in hinted.lower() and "broadcast" not in plain.lower()
