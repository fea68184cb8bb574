"""Plain stream outputs and run figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geotrail.operators.transitions import rejected_messages
from geotrail.sources import locations as loc


def with_event_time(points: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Mark ``ts`` as event time. Only operators that forget old keys read it; the tracker
    itself never drops late points."""
    return points.withWatermark("ts", delay)


def append_history(points: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append every location to a folder where history lands. ``settle_days`` brings finished
    days from there into the sorted table."""
    rows = loc.history_rows(points)
    return _files(rows, path, checkpoint, trigger, "event_date", **loc.DEVICE_FILTERS)


def publish_files(records: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Publish the ``value`` of message records as lines of files, for readers without a topic."""
    return (
        records.select("value")
        .writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def keep_rejected(parsed: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Set unusable location records aside with their text and, where known, their topic
    position."""
    return _files(loc.rejected(parsed), path, checkpoint, trigger)


def keep_rejected_events(
    records: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
):
    """The same for event messages."""
    return _files(rejected_messages(records), path, checkpoint, trigger)


def _files(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None,
    *partitions: str,
    **options: str,
):
    writer = rows.writeStream.format("parquet").options(**options).option("path", path)
    if partitions:
        writer = writer.partitionBy(*partitions)
    return (
        writer.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def print_points(points: DataFrame, checkpoint: str, trigger: dict | None = None):
    """Show the parsed stream on the console, for debugging."""
    return (
        points.writeStream.format("console")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def counted(df: DataFrame, name: str) -> DataFrame:
    """Count rows and their time range as they pass; the figures show in a stream's progress under
    ``name``, from which ``figures.KeptFigures`` keeps them."""
    return df.observe(
        name,
        F.count(F.lit(1)).alias("rows"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )


def run_figures(query: StreamingQuery) -> dict:
    """Rows and rates of all reported triggers of a query."""
    reports = [dict(p) for p in query.recentProgress]
    seconds = sum(p["durationMs"].get("triggerExecution", 0) for p in reports) / 1000
    rows = sum(p["numInputRows"] for p in reports)
    return {
        "triggers": len(reports),
        "rows": rows,
        "seconds": seconds,
        "rows_per_second": rows / seconds if seconds else 0.0,
    }
