"""Visits: enter events closed by exit events of the same device and fence.

Rule: an enter opens a visit; an exit closes the oldest visit of its (device, polygon) that
is still open, and does nothing when none is. With E enters and X exits read so far and M the
lowest value of E - X so far (at most 0), the exits without effect number -M, so an effective
exit is the (X + M)-th one and closes the visit of the enter with that number. All three are
running sums, so a prefix scan over ranges gives them for a pair of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotrail.functions import messages
from geotrail.operators.scan import Measures, scanned
from geotrail.operators.sizing import SplitPolicy, settled

KEYS = ["device", "polygon"]


def _order(rows: DataFrame) -> list[str]:
    """``order_ts``, when present, replaces the event time as the order of reading."""
    return ["order_ts" if "order_ts" in rows.columns else "event_ts", "seq", "_is_exit"]


def _running(rows: DataFrame, order: list[str], policy: SplitPolicy | None) -> DataFrame:
    """``_enters, _exits, _lowest`` up to each event of its pair; by ranges under a policy."""
    exits = F.col("_is_exit").cast("bigint")
    if policy is not None:
        steps = rows.withColumns({"_in": 1 - exits, "_out": exits, "_step": 1 - 2 * exits})
        measures = Measures(
            sums={"_enters": "_in", "_exits": "_out"}, lows={"_lowest": "_step"}
        )
        return scanned(steps, KEYS, order, measures, policy.cut(rows))
    so_far = Window.partitionBy(*KEYS).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumns(
        {"_enters": F.sum(1 - exits).over(so_far), "_exits": F.sum(exits).over(so_far)}
    )
    return counted.withColumn(
        "_lowest",
        F.least(F.lit(0).cast("bigint"), F.min(F.col("_enters") - F.col("_exits")).over(so_far)),
    )


def visits(
    events: DataFrame, policy: SplitPolicy | None = None, stored: bool = False
) -> DataFrame:
    """``device, polygon, inside, enter_ts, enter_point, exit_ts, exit_point``.

    ``events`` as returned by ``collision_events``; open visits have NULL exit columns.
    Events already hashed by device are not exchanged again. Splitting hot keys reads the
    events more than once, so unless they come straight from a table (``stored``) they are
    checkpointed first where the cluster names a folder for that.
    """
    policy = policy or SplitPolicy()
    if not stored and policy.looks_into(events):
        events = settled(events)
    split = policy.applies_to(events, KEYS)
    rows = events.withColumn("_is_exit", F.col("event_type") != messages.ENTER)
    order = _order(rows)
    rows = _running(rows, order, policy if split else None)
    # An exit without effect repeats the number of the last effective one and sorts after it.
    number = F.when(~F.col("_is_exit"), F.col("_enters")).otherwise(
        F.col("_exits") + F.col("_lowest")
    )
    same_number = Window.partitionBy(*KEYS, "_number").orderBy("_is_exit", *order[:2])
    closing = F.struct(F.col("event_ts").alias("ts"), F.struct("x", "y").alias("point"))
    closing = F.when(F.col("_is_exit"), closing)
    return (
        rows.withColumn("_number", number)
        .withColumn("_exit", F.lead(closing).over(same_number))
        .where(~F.col("_is_exit"))
        .select(
            *KEYS,
            F.col("_exit").isNull().alias("inside"),
            F.col("event_ts").alias("enter_ts"),
            F.struct("x", "y").alias("enter_point"),
            F.col("_exit.ts").alias("exit_ts"),
            F.col("_exit.point").alias("exit_point"),
        )
    )
