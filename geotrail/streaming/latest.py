"""The last location of each device, in two tables that differ on purpose.

``latest_view`` holds the last arrival with the time as it was sent, to the microsecond; it is
kept up by a stream of its own. ``tracker_state`` belongs to the tracker: its clock is cut to
milliseconds, and within a batch its points count in the order of time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotrail.operators import keyed
from geotrail.streaming.store import KeyedTable

POINT = [
    T.StructField("device", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
]
STATE = T.StructType([*POINT, T.StructField("inside", T.ArrayType(T.LongType()))])


def tracker_state(spark: SparkSession, root: str, fanout: int = 4) -> KeyedTable:
    """Last point and containing fences per device."""
    return KeyedTable(spark, root, STATE, ["device"], "device", fanout=fanout)


def latest_view(spark: SparkSession, root: str, fanout: int = 4) -> KeyedTable:
    """Last arrival per device."""
    schema = T.StructType(POINT)
    return KeyedTable(spark, root, schema, ["device"], "device", fanout=fanout)


def last_points(points: DataFrame) -> DataFrame:
    """The last point per device of one batch, by time and then arrival."""
    values = F.struct("seq", "ts", "x", "y")
    return (
        points.groupBy("device")
        .agg(F.max_by(values, F.struct("ts", "seq")).alias("_v"))
        .select("device", "_v.*")
    )


def latest_batch(view: KeyedTable) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch`` on points: the last arrival of each device in the batch
    replaces the stored one, whatever the times."""

    def run(batch: DataFrame, number: int) -> None:
        view.put(number, keyed.latest_locations(batch))

    return run


def record_latest(
    points: DataFrame, view: KeyedTable, checkpoint: str, trigger: dict | None = None
):
    """Start keeping the view of a stream of points ``device, seq, ts, x, y``. A batch writes
    its own devices and reads nothing."""
    return (
        points.writeStream.foreachBatch(latest_batch(view))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )
