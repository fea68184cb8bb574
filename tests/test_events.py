"""Transitions, by hand and on skewed data."""

import pytest
from conftest import START, rows
from pyspark.sql import functions as F

from geotrail.operators.containment import FenceIndex
from geotrail.operators.sizing import SplitPolicy
from geotrail.operators.transitions import collision_events, tracker_clock
from geotrail.sources import sample_tables as sample

A = (1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))")
B = (2, "POLYGON ((8 0, 20 0, 20 10, 8 10, 8 0))")


def steps(events):
    return [
        (r.event_type, r.polygon, r.device, r.seq)
        for r in events.orderBy("device", "seq", F.desc("event_type"), "polygon").collect()
    ]


@pytest.mark.parametrize("strategy", ["cells", "grid"])
def test_hand_cases(points, fences, strategy):
    index = FenceIndex(fences(A, B), strategy)
    located = points(
        (1, 5, 5),  # first point inside: enter A
        (1, 6, 5),  # stays
        (1, 9, 5),  # overlap: enter B as well
        (1, 15, 5),  # leaves A
        (1, 5, 5),  # B -> A in one step
        (1, 10, 5),  # on A's edge, inside B
        (1, 30, 5),  # outside all
        (2, -50, -1),  # another device, never inside
        (1, 5, 5),  # back in A
    )
    assert steps(collision_events(located, index)) == [
        ("enter", 1, 1, 0),
        ("enter", 2, 1, 2),
        ("exit", 1, 1, 3),
        ("exit", 2, 1, 4),
        ("enter", 1, 1, 4),
        ("exit", 1, 1, 5),
        ("enter", 2, 1, 5),
        ("exit", 2, 1, 6),
        ("enter", 1, 1, 8),
    ]


def test_events_carry_the_point_and_millisecond_time(spark, fences):
    index = FenceIndex(fences((1, "POLYGON ((-10 -10, 10 -10, 10 10, -10 10, -10 -10))")))
    located = spark.sql(
        "select 4L as device, 1L as seq, timestamp_micros(1709995370493877) as ts,"
        " -3.5D as x, 1.0E-5D as y"
    )
    event = collision_events(tracker_clock(located), index).select(
        "x", "y", F.unix_micros("event_ts").alias("us"), "in"
    ).first()
    assert tuple(event) == (-3.5, 1e-5, 1709995370493000, True)


def test_arrival_breaks_ties_of_time(spark, fences):
    index = FenceIndex(fences(A))
    located = spark.createDataFrame(
        [(1, 1, START, 50.0, 5.0), (1, 0, START, 5.0, 5.0)],
        "device long, seq long, ts timestamp, x double, y double",
    )
    assert steps(collision_events(located, index)) == [("enter", 1, 1, 0), ("exit", 1, 1, 1)]


@pytest.fixture(scope="module")
def skewed(spark, folder):
    """The sample with a third of all points given to one device."""
    located = tracker_clock(sample.locations(spark, folder))
    return located.withColumn("device", F.expr("if(seq % 3 = 0, 0, device)"))


@pytest.mark.parametrize("strategy", ["cells", "grid"])
def test_a_device_with_a_third_of_the_points(spark, folder, skewed, strategy):
    known = sample.outlined_fences(spark, folder)
    policy = SplitPolicy().forced(target_rows=100)
    whole = collision_events(skewed, FenceIndex(known), policy.off())
    cut = collision_events(skewed, FenceIndex(known, strategy, policy), policy)
    columns = ["event_type", "polygon", "device", "x", "y", "event_ts", "seq"]
    assert rows(cut, *columns) == rows(whole, *columns)
    assert whole.where("device = 0").count() > 500


def test_previous_state_continues_a_sequence(points, fences):
    index = FenceIndex(fences(A))
    known = points((1, 5, 5)).withColumn("inside", F.expr("array(1L)"))
    later = points((9, 0, 0), (1, 6, 6), (1, 50, 5)).where("device = 1")
    for policy in (SplitPolicy().off(), SplitPolicy().forced(target_rows=1)):
        events = collision_events(later, index, policy, known)
        assert steps(events) == [("exit", 1, 1, 2)]
