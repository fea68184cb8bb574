"""Visits kept up from a stream of events that may come late, twice and in any order.

What is stored is one row per event: an enter with the exit that closes it, if there is one, or
an exit without a visit. A batch reads the rows of its own (device, polygon) pairs that its
events can still change: those that are open or end at or after the first of its events. The
batch's events and those of these rows are paired anew by the batch operator, so the result is
that of all events read in order of time. An event that is already stored changes nothing, and
no event is ever too late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotrail import schemas
from geotrail.functions import messages
from geotrail.operators.sizing import SplitPolicy
from geotrail.operators.transitions import accepted_messages, read_messages
from geotrail.operators.visits import visits
from geotrail.streaming.store import KeyedTable

PAIR = ["device", "polygon"]
# An event is its content: the same message again is the same event.
IDENTITY = [*PAIR, "event_type", "event_ts", "x", "y"]
# An enter is over when it is left, an exit without a visit when it happens.
ENDED = f"if(event_type = '{messages.ENTER}', exit_ts, event_ts)"
RECORD = T.StructType(
    [
        T.StructField("device", T.LongType()),
        T.StructField("polygon", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("seq", T.LongType()),
        T.StructField("exit_ts", T.TimestampType()),
        T.StructField("exit_point", schemas.POINT),
        T.StructField("exit_seq", T.LongType()),
        # An exit that has found its visit since is part of that row.
        T.StructField("gone", T.BooleanType()),
        # An enter that changed after it had gone to the folder of the day it was left on.
        T.StructField("late", T.BooleanType()),
    ]
)


class VisitStore:
    """Visits under ``root``. Those that ended more than ``settle_after`` seconds before the
    newest event of a batch are settled: they go to folders by the day they ended, which later
    batches read only for events that are as late."""

    def __init__(
        self, spark: SparkSession, root: str, fanout: int = 4, settle_after: int = 86_400
    ):
        self.settle_after = settle_after
        self.rows = KeyedTable(
            spark, root, RECORD, IDENTITY, "device", fanout=fanout, day=f"cast({ENDED} as date)"
        )

    def settled(self, newest_micros: int):
        """Which rows are settled by an event time in microseconds."""
        horizon = F.timestamp_micros(F.lit(newest_micros - self.settle_after * 1_000_000))
        return (F.expr(ENDED) < horizon) & ~F.col("late")

    def read(self) -> DataFrame:
        """All visits as of the last finished batch."""
        entered = self.rows.read().where(F.col("event_type") == messages.ENTER)
        return entered.select(
            *PAIR,
            F.col("exit_ts").isNull().alias("inside"),
            F.col("event_ts").alias("enter_ts"),
            F.struct("x", "y").alias("enter_point"),
            "exit_ts",
            "exit_point",
        )


def arriving_events(records: DataFrame) -> DataFrame:
    """Usable events of message records; see ``rejected_messages`` for the others."""
    return read_messages(accepted_messages(records))


def _stored_events(rows: DataFrame) -> DataFrame:
    """The events that stored rows stand for."""
    late = F.col("late") | (F.col("_archived") & (F.col("event_type") == messages.ENTER))
    own = rows.select(*IDENTITY, "seq", late.alias("late"))
    closing = rows.where("exit_ts is not null").select(
        *PAIR,
        F.lit(messages.EXIT).alias("event_type"),
        F.col("exit_ts").alias("event_ts"),
        F.col("exit_point.x").alias("x"),
        F.col("exit_point.y").alias("y"),
        F.col("exit_seq").alias("seq"),
        F.lit(False).alias("late"),
    )
    return own.unionByName(closing)


def record_batch(
    store: VisitStore, policy: SplitPolicy | None = None
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch`` on events; replaying a batch gives the same table."""
    policy = policy or SplitPolicy()

    def run(batch: DataFrame, number: int) -> None:
        fresh = batch.select(*IDENTITY, "seq").where(
            "device is not null and polygon is not null and event_ts is not null"
        )
        fresh = fresh.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            size, newest, first_day = fresh.agg(
                F.count(F.lit(1)),
                F.unix_micros(F.max("event_ts")),
                F.min("event_ts").cast("date").cast("string"),
            ).first()
            if not size:
                return
            since = fresh.groupBy(*PAIR).agg(F.min("event_ts").alias("_since"))
            stored = store.rows.read(number, store.rows.needed(fresh), first_day, "_archived")
            still = F.when(
                F.col("event_type") == messages.ENTER,
                F.col("exit_ts").isNull() | (F.col("exit_ts") >= F.col("_since")),
            ).otherwise(F.col("event_ts") >= F.col("_since"))
            touched = stored.where("not gone").join(since, PAIR).where(still).drop("_since")
            touched = touched.persist(StorageLevel.MEMORY_AND_DISK)
            events = (
                _stored_events(touched)
                .unionByName(fresh.withColumn("late", F.lit(False)))
                .groupBy(*IDENTITY)
                .agg(F.min("seq").alias("seq"), F.max("late").alias("late"))
                .withColumn("in", F.col("event_type") == messages.ENTER)
                .persist(StorageLevel.MEMORY_AND_DISK)
            )
            split = policy.for_batch(events, PAIR, size)
            changes = _changes(events, touched, split)
            store.rows.put(number, changes, store.settled(newest))
            events.unpersist()
            touched.unpersist()
        finally:
            fresh.unpersist()

    return run


def _changes(events: DataFrame, touched: DataFrame, policy: SplitPolicy) -> DataFrame:
    """Stored rows of the pairs' events, as they are paired now."""
    paired = visits(events, policy).select(
        *PAIR,
        F.lit(messages.ENTER).alias("event_type"),
        F.col("enter_ts").alias("event_ts"),
        F.col("enter_point.x").alias("x"),
        F.col("enter_point.y").alias("y"),
        "exit_ts",
        "exit_point",
    )
    # The order of arrival stays with its event.
    known = events.select(*IDENTITY, "seq", "late")
    of_exit = known.where(F.col("event_type") == messages.EXIT).select(
        *PAIR,
        F.col("event_ts").alias("exit_ts"),
        F.struct("x", "y").alias("exit_point"),
        F.col("seq").alias("exit_seq"),
    )
    entered = (
        paired.join(known, IDENTITY)
        .join(of_exit, [*PAIR, "exit_ts", "exit_point"], "left")
        .withColumn("gone", F.lit(False))
    )
    closing = paired.where("exit_ts is not null").select(
        *PAIR,
        F.col("exit_ts").alias("event_ts"),
        F.col("exit_point.x").alias("x"),
        F.col("exit_point.y").alias("y"),
        F.lit(True).alias("gone"),
    )
    place = [*PAIR, "event_ts", "x", "y"]
    was_alone = touched.where(F.col("event_type") == messages.EXIT).select(
        *place, F.lit(True).alias("_was")
    )
    alone = (
        known.where(F.col("event_type") == messages.EXIT)
        .join(closing, place, "left")
        .join(was_alone, place, "left")
        .withColumn("gone", F.coalesce("gone", F.lit(False)))
        # An exit that was never stored by itself need not be taken back.
        .where("not gone or _was")
        .withColumn("exit_ts", F.lit(None).cast("timestamp"))
        .withColumn("exit_point", F.lit(None).cast(schemas.POINT))
        .withColumn("exit_seq", F.lit(None).cast("bigint"))
    )
    columns = RECORD.fieldNames()
    return entered.select(*columns).unionByName(alone.select(*columns))


def record_visits(
    events: DataFrame, store: VisitStore, checkpoint: str, policy: SplitPolicy | None = None,
    trigger: dict | None = None,
):
    return (
        events.writeStream.foreachBatch(record_batch(store, policy))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )
