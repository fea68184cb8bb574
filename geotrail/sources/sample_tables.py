"""The domain tables as views over the sample star schema in a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail import session
from geotrail.functions import geometry as geo
from geotrail.sources.dimensions import with_outline


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return session.pin(spark).read.parquet(f"{folder}/{name}.parquet")


def _as_locations(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("device"),
        ((F.col("value") * 7.3) % 100).alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        "ts",
    )


def locations(spark: SparkSession, folder: str) -> DataFrame:
    """``seq, device, x, y, ts``."""
    return _as_locations(_table(spark, folder, "events"))


def location_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same locations as a stream over the table's files."""
    source = spark.readStream.schema(_table(spark, folder, "events").schema)
    events = source.option("pathGlobFilter", "events.parquet").parquet(folder)
    return _as_locations(events).withColumn("ts", F.col("ts").cast("timestamp"))


def fences(spark: SparkSession, folder: str) -> DataFrame:
    """``id, category, valid, creation, wkt``: rectangles, triangles, rectangles with a hole."""
    corner = "named_struct('x', {}, 'y', {})"

    def ring(*corners: tuple[str, str]) -> str:
        return "array(" + ", ".join(corner.format(x, y) for x, y in corners) + ")"

    def rectangle(left: str, low: str, right: str, high: str) -> str:
        return ring((left, low), (right, low), (right, high), (left, high), (left, low))

    outer = rectangle("x0", "y0", "x0 + w", "y0 + h")
    hole = rectangle("x0 + w / 4", "y0 + h / 4", "x0 + w / 2", "y0 + h / 2")
    triangle = ring(("x0", "y0"), ("x0 + w", "y0"), ("x0", "y0 + h"), ("x0", "y0"))
    return (
        _table(spark, folder, "nation")
        .selectExpr(
            "cast(n_nationkey as bigint) as n", "cast(n_regionkey as bigint) as category"
        )
        .selectExpr(
            "*",
            "cast(n * 13 % 80 as double) as x0",
            "cast(n * 29 % 70 as double) as y0",
            "cast(n * 7 % 25 + 10 as double) as w",
            "cast(n * 11 % 30 + 10 as double) as h",
        )
        .selectExpr(
            "*",
            f"case n % 3 when 0 then array({outer}) when 1 then array({triangle})"
            f" else array({outer}, {hole}) end as shape",
        )
        .selectExpr(
            "n as id",
            "category",
            "n % 10 <> 9 as valid",
            "cast('2024-01-01 00:00:00' as timestamp_ntz) as creation",
            f"{geo.polygon_wkt('shape')} as wkt",
        )
    )


def outlined_fences(spark: SparkSession, folder: str) -> DataFrame:
    """Fences with ``rings`` read back from their text."""
    return with_outline(fences(spark, folder))


def categories(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "region").select(
        F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name")
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    """``id, device``; some devices have no user."""
    key = F.col("c_custkey")
    return (
        _table(spark, folder, "customer")
        .where(key % 7 != 3)
        .select((key + 1).alias("id"), key.alias("device"))
    )
