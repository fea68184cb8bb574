"""Batch jobs from table to table, for backfills and for runs without a stream.

Each job writes a table that the next one and the read queries start from, so no long
computation is repeated and a lost executor costs only its current stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail import session
from geotrail.operators import keyed
from geotrail.operators.containment import FenceIndex, resolution
from geotrail.operators.sizing import SplitPolicy, estimated_bytes
from geotrail.operators.transitions import collision_events, tracker_clock
from geotrail.operators.visits import visits


def _prepare(rows: DataFrame) -> SparkSession:
    spark = session.pin(rows.sparkSession)
    session.size_shuffles(spark, estimated_bytes(rows))
    return spark


def write_events(
    points: DataFrame, fences: DataFrame, path: str, policy: SplitPolicy | None = None
) -> None:
    """Enter and exit events of ``points`` (``device, seq, ts, x, y``; best a stored table, as
    the split of hot devices reads it more than once)."""
    _prepare(points)
    policy = policy or SplitPolicy()
    index = FenceIndex(fences, policy=policy, cells_per_fence=resolution(points)).pin()
    collision_events(tracker_clock(points), index, policy).write.mode("overwrite").parquet(path)


def write_visits(
    spark: SparkSession, events_path: str, path: str, policy: SplitPolicy | None = None
) -> None:
    """Visits of a stored event table, laid out for the visit queries: by day of entering,
    sorted by device within a day."""
    events = spark.read.parquet(events_path)
    _prepare(events)
    by = ["enter_date", "device", "enter_ts"]
    (
        visits(events, policy, stored=True)
        .withColumn("enter_date", F.col("enter_ts").cast("date"))
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .write.mode("overwrite")
        .partitionBy("enter_date")
        .parquet(path)
    )


def write_latest(points: DataFrame, path: str) -> None:
    """Latest location per device."""
    _prepare(points)
    keyed.latest_locations(points).write.mode("overwrite").parquet(path)
