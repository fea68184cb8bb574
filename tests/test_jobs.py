import re

from conftest import rows
from pyspark.sql import functions as F

from geotrail import session
from geotrail.operators import keyed, ordered
from geotrail.operators.containment import FenceIndex
from geotrail.operators.sizing import SplitPolicy
from geotrail.operators.transitions import collision_events, tracker_clock
from geotrail.operators.visits import visits
from geotrail.plans import jobs, reads
from geotrail.sources import sample_tables as sample


def test_jobs_from_table_to_table(spark, folder, tmp_path):
    points = sample.locations(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    stored = str(tmp_path / "points")
    points.write.parquet(stored)
    fences = sample.outlined_fences(spark, folder)
    policy = SplitPolicy().forced(target_rows=30)
    events_at, visits_at, latest_at = (str(tmp_path / n) for n in ("events", "visits", "latest"))
    jobs.write_events(spark.read.parquet(stored), fences, events_at, policy)
    jobs.write_visits(spark, events_at, visits_at, policy)
    jobs.write_latest(spark.read.parquet(stored), latest_at)

    want = visits(collision_events(tracker_clock(points), FenceIndex(fences)))
    got = spark.read.parquet(visits_at)
    columns = ["device", "polygon", "inside", "enter_ts", "exit_ts"]
    assert rows(got, *columns) == rows(want, *columns)
    latest = spark.read.parquet(latest_at)
    assert rows(latest, "device", "seq") == rows(keyed.latest_locations(points), "device", "seq")

    users = sample.users(spark, folder)
    time = "2024-01-05T00:00:00;2024-01-06T00:00:00"
    asked = reads.visit_history(got, users, time)
    assert "PartitionFilters: [isnotnull(enter_date" in (
        asked._jdf.queryExecution().executedPlan().toString()
    )
    assert rows(asked, "id_device", "id_polygon", "enter_date") == rows(
        reads.visit_history(want, users, time), "id_device", "id_polygon", "enter_date"
    )


def test_split_rows_are_spread_even_when_they_lie_by_key(spark, folder):
    """A scan must not leave the rows of one device in one task."""
    points = sample.locations(spark, folder).withColumn("device", F.lit(1).cast("bigint"))
    numbered = ordered.numbered(
        points.repartition(4, "device"), ["device"], ["ts", "seq"], SplitPolicy().forced(100)
    )
    sizes = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 5 and max(sizes) < 400


def test_shuffles_are_sized_by_input(spark):
    try:
        assert session.size_shuffles(spark, 10 << 20) == 4
        assert session.size_shuffles(spark, 10 << 40) == session.MAX_SHUFFLE_PARTITIONS
        assert session.size_shuffles(spark, 100 << 30) == 800
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
