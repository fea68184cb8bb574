"""Text form of locations and collision events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geotrail.functions import times

ENTER = "enter"
EXIT = "exit"


def location_json(device: Column, x: Column, y: Column, micros: Column) -> Column:
    return F.to_json(
        F.struct(
            device.alias("id"),
            F.struct(x.alias("x"), y.alias("y")).alias("point"),
            micros.alias("timestamp"),
        )
    )


def event_json(
    event_type: Column, polygon: Column, device: Column, x: Column, y: Column, millis: Column
) -> Column:
    """Enter/exit message. Field order, spacing and the quoted date are a fixed format."""
    entered = event_type == ENTER
    side = F.when(entered, F.lit("in")).otherwise(F.lit("out"))

    def text(value: Column) -> Column:
        return value.cast("string")

    return F.concat(
        F.lit('{"event_type": "'), event_type,
        F.lit('", "polygon": '), text(polygon),
        F.lit(', "device": '), text(device),
        F.lit(', "in": '), text(entered),
        F.lit(', "collision_point_'), side,
        F.lit('": {"x": '), text(x), F.lit(', "y": '), text(y),
        F.lit('}, "collision_date_'), side,
        F.lit('": "'), text(millis), F.lit('"}'),
    )


def content_key(value: Column) -> Column:
    """Message key: hex MD5 of the UTF-8 text, so equal messages share a key."""
    return F.md5(value.cast("binary"))


def event_fields(doc: str) -> list[Column]:
    """Columns ``event_type, polygon, device, in, x, y, event_ts`` of a parsed message.

    Every type but "enter" counts as an exit.
    """
    entered = F.col(f"{doc}.event_type") == ENTER

    def sided(field: str) -> Column:
        return F.when(entered, F.col(f"{doc}.{field.format('in')}")).otherwise(
            F.col(f"{doc}.{field.format('out')}")
        )

    return [
        F.when(entered, F.lit(ENTER))
        .when(F.col(f"{doc}.event_type").isNotNull(), F.lit(EXIT))
        .alias("event_type"),
        F.col(f"{doc}.polygon").try_cast("bigint").alias("polygon"),
        F.col(f"{doc}.device").try_cast("bigint").alias("device"),
        F.col(f"{doc}.in").alias("in"),
        sided("collision_point_{}.x").alias("x"),
        sided("collision_point_{}.y").alias("y"),
        times.from_millis(sided("collision_date_{}").try_cast("bigint")).alias("event_ts"),
    ]
