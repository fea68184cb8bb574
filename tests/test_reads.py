from datetime import datetime, timedelta

import pytest
from conftest import START, rows

from geotrail.operators import keyed
from geotrail.operators.sizing import SplitPolicy
from geotrail.plans import reads
from geotrail.sources import locations as loc


@pytest.fixture(scope="module")
def users(spark):
    # 1 and 9 share device 10; device 30 has no user; user 4 has no device.
    return spark.createDataFrame([(1, 10), (9, 10), (2, 20), (4, None)], "id long, device long")


@pytest.fixture(scope="module")
def located(spark):
    return spark.createDataFrame(
        [
            (10, 0, START, 1.0, 1.0),
            (20, 1, START + timedelta(minutes=1), 2.0, 2.0),
            (30, 2, START + timedelta(minutes=2), 3.0, 3.0),
            (10, 3, START + timedelta(minutes=3), 4.0, 4.0),
            (10, 4, START - timedelta(minutes=9), 5.0, 5.0),  # arrives late
        ],
        "device long, seq long, ts timestamp, x double, y double",
    )


@pytest.fixture(scope="module")
def history(located):
    return loc.history_rows(located)


@pytest.fixture(scope="module")
def stays(spark):
    def at(minute):
        return START + timedelta(minutes=minute)

    return spark.createDataFrame(
        [
            (10, 1, False, at(0), (1.0, 1.0), at(5), (2.0, 2.0)),
            (10, 2, True, at(10), (1.0, 1.0), None, None),
            (30, 1, True, at(10), (3.0, 3.0), None, None),
            (20, 1, False, at(20), (4.0, 4.0), at(21), (5.0, 5.0)),
        ],
        "device long, polygon long, inside boolean, enter_ts timestamp,"
        " enter_point struct<x:double,y:double>, exit_ts timestamp,"
        " exit_point struct<x:double,y:double>",
    )


def test_latest_is_the_last_arrival(located):
    assert rows(keyed.latest_locations(located), "device", "x") == [(10, 5.0), (20, 2.0), (30, 3.0)]


def test_actual_locations(located, users):
    latest = keyed.latest_locations(located)
    every = reads.actual_locations(latest, users)
    assert rows(every, "user_id", "device_id", "x") == [(1, 10, 5.0), (2, 20, 2.0), (9, 10, 5.0)]
    assert rows(reads.actual_locations(latest, users, []), "user_id") == [(1,), (2,), (9,)]
    assert rows(reads.actual_locations(latest, users, [2, 4, 77]), "user_id") == [(2,)]
    assert rows(reads.actual_locations(latest, users, [77]), "user_id") == []


def test_active_users_name_one_user_per_device(located, users):
    latest = keyed.latest_locations(located)
    assert rows(reads.active_users(latest, users), "user_id", "device_id") == [(2, 20), (9, 10)]


def test_trajectories(history, users):
    mapped = reads.trajectories(history, users, "2024-03-01")
    assert rows(mapped, "id_user", "id_device", "ordinal", "x") == [
        (2, 20, 1, 2.0), (9, 10, 1, 1.0), (9, 10, 2, 4.0),
    ]
    # The mapping follows the users asked for.
    one = reads.trajectories(history, users, "2024-03-01", [1])
    assert rows(one, "id_user", "x") == [(1, 1.0), (1, 4.0)]
    pages = reads.trajectory_pages(history, users, "2024", policy=SplitPolicy().forced(1))
    nested = {r.id_device: [p.point.x for p in r.trajectory] for r in pages.collect() if r.first_ordinal == 1}
    assert nested[20] == [2.0] and nested[10][0] == 5.0


def test_one_user(history, users):
    every = reads.user_trajectory(history, users, 9)
    assert rows(every, "in_time", "id_user", "id_device", "x") == [
        ("all", 9, 10, 1.0), ("all", 9, 10, 4.0), ("all", 9, 10, 5.0),
    ]
    minute = reads.user_trajectory(history, users, 9, "2024-03-01T00:03")
    assert rows(minute, "x") == [(4.0,)]
    assert rows(reads.user_trajectory(history, users, 77), "x") == []
    assert rows(reads.user_trajectory(history, users, 4), "x") == []


def test_visit_history_looks_at_the_enter_time(stays, users):
    def asked(time, **lists):
        found = reads.visit_history(stays, users, time, **lists)
        return rows(found, "id_user", "id_device", "id_polygon")

    # Entered before the window and left within it: not returned. Both bounds count.
    assert asked("2024-03-01T00:01:00;2024-03-01T00:10:00") == [(9, 10, 2), (None, 30, 1)]
    assert asked("2024-03-01T00:10:00;2024-03-01T00:20:00") == [
        (2, 20, 1), (9, 10, 2), (None, 30, 1),
    ]
    assert asked("2024-03-01T00:00:00", polygons=[2]) == [(9, 10, 2)]
    assert asked("2024-03-01T00:00:00", ids=[1]) == [(1, 10, 1), (1, 10, 2)]
    assert asked("2024-03-01T00:00:00", ids=[77]) == []
    assert len(asked("2024-03-01T00:00:00", polygons=[], ids=[])) == 4


def test_visit_pages(stays, users):
    pages = reads.visit_history_pages(stays, users, "2024-03-01T00:00:00").collect()
    ten = next(p for p in pages if p.id_device == 10)
    assert (ten.id_user, ten.time) == (9, "2024-03-01T00:00:00")
    assert [c.id_polygon for c in ten.collisions] == [1, 2]
    assert ten.collisions[0].exit_point == [2.0, 2.0] and ten.collisions[1].exit_point is None


def test_currently_inside(stays, users):
    now = reads.currently_inside(stays, users)
    assert rows(now, "id_user", "id_device", "id_polygon") == [(9, 10, 2)]
    assert rows(reads.currently_inside(stays, users, polygons=[1]), "id_user") == []
    assert rows(reads.currently_inside(stays, users, ids=[1]), "id_user") == [(1,)]
    page = reads.currently_inside_pages(stays, users).first()
    assert [c.id_polygon for c in page.collisions] == [2]


def test_catalogue(spark, fences):
    square = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
    known = fences((1, square), (2, square, False), (3, square, None))
    names = spark.createDataFrame([(1, "safe"), (2, "other")], "id long, name string")
    assert rows(reads.fence_catalogue(known, names), "id", "category", "fence") == [
        (1, "safe", square), (2, "safe", square), (3, "safe", square),
    ]
    assert rows(reads.fence_catalogue(known, names, valid=True), "id") == [(1,)]
    assert rows(reads.fence_catalogue(known, names, valid=False), "id") == [(2,)]
    assert rows(reads.fence_catalogue(known, names, category=2), "id") == []
    assert rows(reads.fence_catalogue(known, names.where("id = 2")), "id") == []


def test_stored_history_is_pruned_and_sorted(spark, located, users, tmp_path):
    path = str(tmp_path / "history")
    loc.write_history(located, path)
    stored = loc.read_history(spark, path)
    day = reads.in_window(stored, "2024-03-01T00:03;1d")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "GreaterThanOrEqual(timestamp" in plan
    assert rows(day, "point_x") == [(4.0,)]
    one = reads.device_history(stored, 10)
    assert "EqualTo(id,10)" in one._jdf.queryExecution().executedPlan().toString()
    assert rows(loc.as_points(stored), "device", "x") == rows(located, "device", "x")
    assert stored.agg({"timestamp": "max"}).first()[0] == datetime(2024, 3, 1, 0, 3)
