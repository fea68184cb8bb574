"""Location messages: parsing, file and topic sources, history layout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail import schemas
from geotrail.functions import messages, times


def parse_records(records: DataFrame) -> DataFrame:
    """Add ``device, x, y, micros, accepted`` to records with a text column ``value``.

    A field that is missing, or not a number, is NULL; numbers may be quoted. The document
    comes out of a generator, so Catalyst cannot repeat the parsing for each field read.
    """
    doc = F.from_json("value", schemas.LOCATION_MESSAGE, {"mode": "PERMISSIVE"})
    parsed = records.select("*", F.explode(F.array(doc)).alias("_doc")).selectExpr(
        *[f"`{c}`" for c in records.columns],
        "try_cast(_doc.id as bigint) as device",
        "try_cast(_doc.point.x as double) as x",
        "try_cast(_doc.point.y as double) as y",
        "try_cast(_doc.timestamp as bigint) as micros",
    )
    complete = "device is not null and x is not null and y is not null and micros is not null"
    return parsed.selectExpr("*", f"({complete}) as accepted")


def accepted(parsed: DataFrame) -> DataFrame:
    """Usable records as points ``device, x, y, ts`` (microseconds), other columns kept."""
    rest = [c for c in parsed.columns if c not in ("value", "key", "micros", "accepted")]
    return parsed.where("accepted").select(
        *rest, times.from_micros(F.col("micros")).alias("ts")
    )


def rejected(parsed: DataFrame) -> DataFrame:
    """Records set aside, with their text."""
    return parsed.where(~F.col("accepted")).drop("device", "x", "y", "micros", "accepted")


def read_message_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with one JSON message per line, plain or gzip, as ``value``. A gzip file cannot be
    split, so many files of moderate size read best."""
    return spark.read.text(path)


def stream_message_files(spark: SparkSession, path: str, files_per_trigger: int = 1000):
    return (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
    )


def keyed_messages(points: DataFrame) -> DataFrame:
    """Points as topic records ``key, value``; the key is the device id, which keeps a device's
    messages in one topic partition and so in order."""
    value = messages.location_json(
        F.col("device"), F.col("x"), F.col("y"), times.epoch_micros(F.col("ts"))
    )
    return points.select(F.col("device").cast("string").alias("key"), value.alias("value"))


# -- history -------------------------------------------------------------------------------


def history_rows(points: DataFrame) -> DataFrame:
    """Points in the layout of the history table."""
    return points.select(
        F.col("device").alias("id"),
        F.col("x").alias("point_x"),
        F.col("y").alias("point_y"),
        F.col("ts").alias("timestamp"),
        F.col("ts").cast("date").alias("event_date"),
    )


# Where rows lie in order of arrival, the range of ids of a row group says little: a Bloom filter
# of its ids, as large as they need, lets a search for devices skip it.
DEVICE_FILTERS = {
    "parquet.bloom.filter.enabled#id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


def write_history(
    points: DataFrame,
    path: str,
    mode: str = "append",
    seen: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write points partitioned by day and sorted by device and time within a day.

    The range partitioning splits a busy device over many files, and the sort lets the row
    group statistics skip all files but those of the devices asked for. With the mode
    "overwrite" the days of these points are replaced, and no other day. ``seen`` is applied to
    the rows as they are written (``streaming.figures.observed``).
    """
    by = ["event_date", "id", "timestamp"]
    rows = history_rows(points).repartitionByRange(*by).sortWithinPartitions(*by)
    (
        (seen(rows) if seen else rows)
        .write.mode(mode)
        .options(**DEVICE_FILTERS)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(path)
    )


def settle_days(spark: SparkSession, landing: str, path: str, days: list[str]) -> None:
    """Bring some days of a streamed history (``landing``) into the sorted layout of the table
    at ``path``, replacing what the table has of these days. Running it again for a day, or
    after late rows have landed, gives the whole day as it is then."""
    landed = read_history(spark, landing)
    landed = landed.where(F.col("event_date").isin([F.lit(d).cast("date") for d in days]))
    write_history(as_points(landed), path, "overwrite")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HISTORY).parquet(path)


def as_points(history: DataFrame) -> DataFrame:
    return history.select(
        F.col("id").alias("device"),
        F.col("point_x").alias("x"),
        F.col("point_y").alias("y"),
        F.col("timestamp").alias("ts"),
    )


def text_records(rows: DataFrame) -> DataFrame:
    """Give records of a source without topic metadata the columns of a topic record."""
    missing = {
        f.name: F.lit(None).cast(f.dataType)
        for f in schemas.TOPIC_RECORD.fields
        if f.name not in rows.columns
    }
    return rows.withColumns(missing).select(*schemas.TOPIC_RECORD.fieldNames())


