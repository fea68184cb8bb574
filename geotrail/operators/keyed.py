"""Per-device and per-user summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_locations(points: DataFrame, arrival: str = "seq") -> DataFrame:
    """The last arrived point of each device.

    Ordering by one number keeps all aggregate buffers primitive, so this is a hash
    aggregate, combined map-side: a busy device costs one row per task in the exchange.
    """
    others = [c for c in points.columns if c not in ("device", arrival)]
    return points.groupBy("device").agg(
        *[F.max_by(c, arrival).alias(c) for c in others], F.max(arrival).alias(arrival)
    )


def device_users(users: DataFrame) -> DataFrame:
    """``device, id_user``: one user per device, the highest id where several share it."""
    return (
        users.where(F.col("device").isNotNull())
        .groupBy("device")
        .agg(F.max("id").alias("id_user"))
    )


def chosen_users(users: DataFrame, ids: list[int] | None) -> DataFrame:
    """Users with a device, restricted to ``ids``; no ids means all users."""
    owners = users.where(F.col("device").isNotNull())
    return owners.where(F.col("id").isin(list(ids))) if ids else owners


def current_fences(visits: DataFrame) -> DataFrame:
    """The fences each device is in now. The exchange carries open visits only; a device's
    set holds distinct fences that share a point."""
    return (
        visits.where(F.col("inside"))
        .groupBy("device")
        .agg(F.sort_array(F.collect_set("polygon")).alias("polygons"))
    )
