"""Physical-plan checks: no cartesian products or nested-loop joins, pushed
filters and pruned columns at the scans, skew-safe partitioning keys."""

import re

import pytest
from conftest import SF0001

from dialogset.plans.registry import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["w4a_one_sided", "w4b_two_sided", "w5_first_dedup", "w6_last_context_dedup",
                                  "w10_build_dataset", "a17_subsample_ci", "k4_binary_report", "j5_label_lookup_default"])
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan_of(QUERIES[name](spark, SF0001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_annotated_filter_prunes_text(spark):
    df = QUERIES["p1_annotated"](spark, SF0001)
    fmt = df._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution().simpleString() + fmt)
    assert schemas and all("text" not in s for s in schemas)


@pytest.mark.parametrize("name", ["w4a_one_sided_lines", "w4b_two_sided_lines", "w3_no_small_pieces_lines", "w4a_one_sided", "w4b_two_sided"])
def test_windows_move_a_text_once(spark, name):
    """One exchange, by conversation, carries the texts; windows are assembled
    inside it. With hot conversations present (threshold forced to 1 row)
    theirs are assembled by (conversation, block), and the budget lookups are
    partitioned by (conversation, slice): a hot conversation spreads over many
    reducers."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes as at scale: nothing small to broadcast
    try:
        p = plan_of(QUERIES[name](spark, SF0001))
        assert p.count("Exchange") == 1 and "ReusedExchange" not in p and "Join" not in p
        assert re.findall(r"hashpartitioning\(([^)]*)\)", p)[0].count("#") == 3  # the conversation's three keys
        spark.conf.set("dialogset.scan.hotGroupRows", "1")
        p = plan_of(QUERIES[name](spark, SF0001))
    finally:
        spark.conf.unset("dialogset.scan.hotGroupRows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    parts = re.findall(r"hashpartitioning\(([^)]*)\)", p)
    assert any("chunk" in x for x in parts) and any("_blk" in x for x in parts) and any("halo" in x for x in parts)


@pytest.mark.parametrize("name, plain", [("w4a_one_sided_bucketed", "w4a_one_sided_lines"), ("a1_conversations_bucketed", "a1_conversations")])
def test_bucketed_messages_need_no_exchange(spark, name, plain):
    """Grouping, positions and windows follow the stored buckets; the rows are
    those of the plain table, whose texts move once."""
    stored, moved = QUERIES[name](spark, SF0001), QUERIES[plain](spark, SF0001)
    p = plan_of(stored)
    assert "Exchange" not in p and "Bucketed: true" in p and "Window" in p
    assert plan_of(moved).count("Exchange") == 1
    assert sorted(map(str, stored.collect())) == sorted(map(str, moved.collect()))
