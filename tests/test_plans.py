"""Shape of the physical plans."""

import re

import pytest

from geotrail.operators import keyed
from geotrail.operators.containment import FenceIndex, prepared
from geotrail.operators.sizing import SplitPolicy
from geotrail.operators.transitions import collision_events, tracker_clock
from geotrail.operators.visits import visits
from geotrail.sources import sample_tables as sample


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def data_exchanges(plan):
    """Exchanges other than the small one that builds the fence index."""
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_cell" not in line]


@pytest.fixture(scope="module")
def index(spark, folder):
    return FenceIndex(sample.outlined_fences(spark, folder))


@pytest.fixture(scope="module")
def located(spark, folder):
    return tracker_clock(sample.locations(spark, folder))


def test_events_and_visits_share_one_exchange_by_device(located, index):
    for df in (collision_events(located, index), visits(collision_events(located, index))):
        plan = plan_of(df)
        assert len(data_exchanges(plan)) == 1
        assert re.search(r"Exchange hashpartitioning\(device#", data_exchanges(plan)[0])
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_containment_is_a_broadcast_hash_join_without_exchange(located, index):
    plan = plan_of(index.inside_sets(located))
    assert "BroadcastHashJoin" in plan and not data_exchanges(plan)


def test_grid_plan_has_no_nested_loop(spark, folder, located):
    grid = FenceIndex(sample.outlined_fences(spark, folder), "grid")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(collision_events(located, grid))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # Points by cell, fences by cell, and the regrouping by device.
    assert len(data_exchanges(plan)) == 3


def test_split_plan_broadcasts_only_bounded_sides(located, index):
    plan = plan_of(collision_events(located, index, SplitPolicy().forced(10)))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_latest_is_a_hash_aggregate_on_needed_columns(spark, folder):
    plan = plan_of(keyed.latest_locations(sample.locations(spark, folder)).select("device", "x"))
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan


def test_index_build_parses_each_outline_once(spark, folder, index):
    def parses(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract")

    assert parses(prepared(sample.outlined_fences(spark, folder))) == 1
    # The cells start from the settled fences.
    assert parses(index._cells) == 0
