"""Prefix scans over ranges against a walk along each key."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from geotrail.operators import scan, sizing
from geotrail.operators.scan import Measures

SCHEMA = "key string, part int, at long, seq long, v long, items array<long>"
ORDER = ["at", "seq"]
MEASURES = Measures(sums={"total": "v", "rows": "one"}, lows={"low": "v"}, lags={"last": "items", "was": "v"})


def walk(rows):
    out = []
    by_key = defaultdict(list)
    for r in rows:
        by_key[r[:2]].append(r)
    for own in by_key.values():
        total = low = 0
        last = was = None
        for n, r in enumerate(sorted(own, key=lambda r: r[2:4])):
            total += r[4] or 0
            low = min(low, total)
            out.append((*r, total, n + 1, low, last, was))
            last, was = r[5], r[4]
    return out


def check(spark, rows, ranges):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("one", F.lit(1).cast("bigint")).repartition(3)
    got = scan.scanned(df, ["key", "part"], ORDER, MEASURES, ranges)
    assert got.columns == [*df.columns, "total", "rows", "low", "last", "was"]
    found = [tuple(r) for r in got.drop("one").collect()]
    assert sorted(found, key=repr) == sorted(walk(rows), key=repr)


def sample(seed, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        hot = r.random() < 0.4
        key, part = ("b", 1) if hot else (r.choice(["a", "b", "c", None]), r.choice([0, 1, None]))
        items = r.choice([None, [], [i], [i, None]])
        # Few positions: many rows of one key share one.
        out.append((key, part, r.choice([0, 1, 2]), i, r.choice([-2, -1, 1, None]), items))
    return out


@pytest.mark.parametrize("batch", [1, 7, 10_000])
@pytest.mark.parametrize("ranges", [1, 4, 60])
def test_against_a_walk(spark, ranges, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        check(spark, sample(ranges), ranges)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("batch", [7, 10_000])
@pytest.mark.parametrize("tasks,rows", [(1, 7), (4, 7), (4, 1), (3, 150)])
def test_several_ranges_in_a_task(spark, tasks, rows, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        check(spark, sample(tasks), sizing.Cut(400, tasks, rows))
        check(spark, [], sizing.Cut(400, tasks, rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_ranges_share_a_bounded_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(sizing, "TASKS", 8)
    df = spark.createDataFrame(sample(2), SCHEMA)
    cut = sizing.SplitPolicy().forced(target_rows=10).cut(df)
    assert (cut.ranges, cut.tasks) == (40, 8)
    rows = scan.ranged(df, ["key", "part"], ORDER, cut)
    sizes = [r["count"] for r in rows.groupBy(scan.RANGE).count().collect()]
    assert rows.rdd.getNumPartitions() <= 8
    assert sum(sizes) == 400 and max(sizes) <= 10 and 40 <= len(sizes) <= 48
    few = sizing.SplitPolicy().forced(target_rows=100).cut(df)
    assert few.ranges == few.tasks == 4


def test_a_large_batch_is_cut_only_where_a_key_is_hot(spark):
    policy = sizing.SplitPolicy(target_rows=50)
    many, one = spark.range(200), spark.range(200).selectExpr("id % 2 as id")
    assert policy.for_batch(many, ["id"], 200).mode == "off"
    assert policy.for_batch(one, ["id"], 200).mode == "on"
    assert policy.for_batch(one, ["id"], 50).mode == "off"
    assert policy.forced().for_batch(many, ["id"], 200).mode == "on"


def test_more_ranges_than_rows_and_an_empty_table(spark):
    check(spark, sample(5, n=6), 50)
    check(spark, [], 5)


def test_one_key_at_one_position_lies_in_many_ranges(spark):
    rows = [("k", 0, 7, i, 1, [i]) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = scan.ranged(df, ["key", "part"], ORDER, 20).groupBy(scan.RANGE).count().collect()
    assert len(sizes) >= 15 and max(r["count"] for r in sizes) <= 150
    check(spark, rows, 20)


def test_what_is_sent_to_all_tasks_is_one_row_for_a_range(spark):
    df = spark.createDataFrame(sample(9), SCHEMA).withColumn("one", F.lit(1).cast("bigint"))
    rows = scan.ranged(df, ["key", "part"], ORDER, 20)
    carried = scan._carried(rows, ["key", "part"], MEASURES, lambda same: same).collect()
    assert 0 < len(carried) < 20 and len({r["_into"] for r in carried}) == len(carried)


def test_rows_are_exchanged_once_and_read_twice(spark):
    df = spark.range(1000).selectExpr("id % 3 as key", "id as at", "id % 7 - 3 as v")
    got = scan.scanned(df, ["key"], ["at"], Measures(sums={"total": "v"}), 8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # The exchange by range is behind the checkpoint; the other is that of the ranges' summaries.
    assert plan.count("Scan ExistingRDD") == 2 and plan.count("Exchange hashpartitioning") == 1
    assert "NestedLoop" not in plan and "Cartesian" not in plan
