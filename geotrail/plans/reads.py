"""The read queries, as lazy plans over the stored tables.

List arguments follow one rule: an empty or missing list means no restriction. Flat plans
return one row per element; ``*_pages`` plans nest the elements of a user into arrays of
bounded length, one page for all but very long results.

Joins with users and categories carry no broadcast hint: Spark broadcasts a side that its
size check admits, and splits a skewed sort-merge join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.functions import intervals, times
from geotrail.operators import ordered
from geotrail.operators.keyed import chosen_users, device_users
from geotrail.operators.sizing import SplitPolicy


def _is_ntz(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] == "timestamp_ntz"


def actual_locations(
    latest: DataFrame, users: DataFrame, ids: list[int] | None = None
) -> DataFrame:
    """Where users are now: ``user_id, device_id, x, y, timestamp`` (epoch microseconds).
    Users whose device has not reported are left out."""
    owners = chosen_users(users, ids).withColumnRenamed("id", "user_id")
    return owners.join(latest, "device").select(
        "user_id",
        F.col("device").alias("device_id"),
        "x",
        "y",
        times.epoch_micros(F.col("ts")).alias("timestamp"),
    )


def active_users(latest: DataFrame, users: DataFrame) -> DataFrame:
    """``user_id, device_id`` of the devices that have reported."""
    seen = users.join(latest.select("device"), "device", "left_semi")
    return device_users(seen).select(
        F.col("id_user").alias("user_id"), F.col("device").alias("device_id")
    )


# -- history -------------------------------------------------------------------------------


def in_window(history: DataFrame, time: str) -> DataFrame:
    """History rows in a time window, see ``intervals``; "all" for no restriction. The filter
    reaches the scan, and the partitions when the table has ``event_date``."""
    if time == intervals.ALL:
        return history
    date = F.col("event_date") if "event_date" in history.columns else None
    spans = intervals.history_spans(time)
    return history.where(
        intervals.within(F.col("timestamp"), spans, _is_ntz(history, "timestamp"), date)
    )


def device_history(history: DataFrame, device: int, time: str = intervals.ALL) -> DataFrame:
    rows = history.where(F.col("id") == device)
    return in_window(rows, time).select("id", "point_x", "point_y", "timestamp")


def user_trajectory(
    history: DataFrame, users: DataFrame, user: int, time: str = intervals.ALL
) -> DataFrame:
    """Points of one user: ``in_time, id_user, id_device, timestamp, x, y``. Unknown users
    have none. The user's device is a scalar subquery, so it filters the history scan itself."""
    device = users.where(F.col("id") == user).agg(F.max("device")).scalar()
    return in_window(history.where(F.col("id") == device), time).select(
        F.lit(time).alias("in_time"),
        F.lit(user).cast("bigint").alias("id_user"),
        F.col("id").alias("id_device"),
        "timestamp",
        F.col("point_x").alias("x"),
        F.col("point_y").alias("y"),
    )


def _owners(users: DataFrame, ids: list[int] | None) -> DataFrame:
    """``device, id_user`` of the chosen users. Given a list there are no more rows than its
    entries, so it is broadcast; all users are left to Spark's size check."""
    owners = device_users(chosen_users(users, ids))
    return F.broadcast(owners) if ids else owners


def _asked_history(
    history: DataFrame, owners: DataFrame, time: str, ids: list[int] | None
) -> DataFrame:
    rows = in_window(history, time).select(
        F.col("id").alias("device"),
        "timestamp",
        F.col("point_x").alias("x"),
        F.col("point_y").alias("y"),
    )
    return rows.join(owners, "device", "left_semi") if ids else rows


def trajectories(
    history: DataFrame,
    users: DataFrame,
    time: str,
    ids: list[int] | None = None,
    policy: SplitPolicy | None = None,
) -> DataFrame:
    """Flat trajectories of many users: ``in_time, id_user, id_device, ordinal, timestamp, x,
    y``. Devices without a user are left out."""
    owners = _owners(users, ids)
    # Numbered before the join: rows joined by device would lie by device alone.
    numbered = ordered.numbered(
        _asked_history(history, owners, time, ids),
        ["device"],
        ["timestamp", "x", "y"],
        policy or SplitPolicy(),
    )
    return numbered.join(owners, "device").select(
        F.lit(time).alias("in_time"),
        "id_user",
        F.col("device").alias("id_device"),
        "ordinal",
        "timestamp",
        "x",
        "y",
    )


def trajectory_pages(
    history: DataFrame,
    users: DataFrame,
    time: str,
    ids: list[int] | None = None,
    policy: SplitPolicy | None = None,
    page_rows: int = 10_000,
) -> DataFrame:
    """Nested trajectories: ``in_time, id_user, id_device, first_ordinal, trajectory``."""
    owners = _owners(users, ids)
    pages = ordered.paged(
        _asked_history(history, owners, time, ids),
        ["device"],
        ["timestamp", "x", "y"],
        F.struct("timestamp", F.struct("x", "y").alias("point")),
        policy or SplitPolicy(),
        "trajectory",
        page_rows,
    )
    return pages.join(owners, "device").select(
        F.lit(time).alias("in_time"),
        "id_user",
        F.col("device").alias("id_device"),
        "first_ordinal",
        "trajectory",
    )


# -- fences and visits ---------------------------------------------------------------------


def fence_catalogue(
    fences: DataFrame, categories: DataFrame, valid: bool | None = None, category: int | None = None
) -> DataFrame:
    """``id, creation, valid, category, fence``; the category by name, fences of an unknown
    category left out."""
    rows = fences
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if valid is not None:
        rows = rows.where(F.col("valid") == valid)
    names = categories.select(F.col("id").alias("category"), F.col("name"))
    return rows.join(names, "category").select(
        "id", "creation", "valid", F.col("name").alias("category"), F.col("wkt").alias("fence")
    )


def _asked_visits(
    visits: DataFrame, owners: DataFrame, polygons: list[int] | None, ids: list[int] | None
) -> DataFrame:
    rows = visits.where(F.col("polygon").isin(list(polygons))) if polygons else visits
    return rows.join(owners, "device", "left_semi") if ids else rows


def _entered_within(visits: DataFrame, time: str) -> DataFrame:
    date = F.col("enter_date") if "enter_date" in visits.columns else None
    span = intervals.visit_span(time)
    return visits.where(
        intervals.within(F.col("enter_ts"), [span], _is_ntz(visits, "enter_ts"), date)
    )


def _coordinates(point: str) -> Column:
    """``[x, y]``, NULL for a missing point."""
    return F.when(F.col(point).isNotNull(), F.array(F.col(f"{point}.x"), F.col(f"{point}.y")))


def _visit_elements() -> list[Column]:
    return [
        F.col("polygon").alias("id_polygon"),
        F.col("inside"),
        F.col("enter_ts").alias("enter_date"),
        F.col("exit_ts").alias("exit_date"),
        _coordinates("enter_point").alias("enter_point"),
        _coordinates("exit_point").alias("exit_point"),
    ]


def visit_history(
    visits: DataFrame,
    users: DataFrame,
    time: str,
    polygons: list[int] | None = None,
    ids: list[int] | None = None,
) -> DataFrame:
    """Visits entered within ``from[;to]``, one row each. The window looks at the enter time
    only. Devices without a user keep a NULL ``id_user``."""
    owners = _owners(users, ids)
    rows = _asked_visits(_entered_within(visits, time), owners, polygons, ids)
    return rows.join(owners, "device", "left").select(
        F.lit(time).alias("time"),
        "id_user",
        F.col("device").alias("id_device"),
        *_visit_elements(),
    )


def visit_history_pages(
    visits: DataFrame,
    users: DataFrame,
    time: str,
    polygons: list[int] | None = None,
    ids: list[int] | None = None,
    policy: SplitPolicy | None = None,
    page_rows: int = 10_000,
) -> DataFrame:
    """Nested by device: ``time, id_user, id_device, first_ordinal, collisions``."""
    owners = _owners(users, ids)
    rows = _asked_visits(_entered_within(visits, time), owners, polygons, ids)
    pages = _visit_pages(rows, F.struct(*_visit_elements()), policy, page_rows)
    return pages.join(owners, "device", "left").select(
        F.lit(time).alias("time"),
        "id_user",
        F.col("device").alias("id_device"),
        "first_ordinal",
        "collisions",
    )


def _visit_pages(
    rows: DataFrame, element: Column, policy: SplitPolicy | None, page_rows: int
) -> DataFrame:
    return ordered.paged(
        rows,
        ["device"],
        ["enter_ts", "polygon"],
        element,
        policy or SplitPolicy(),
        "collisions",
        page_rows,
    )


def currently_inside(
    visits: DataFrame,
    users: DataFrame,
    polygons: list[int] | None = None,
    ids: list[int] | None = None,
) -> DataFrame:
    """Open visits: ``id_user, id_device, id_polygon, enter_date``; devices without a user are
    left out."""
    owners = _owners(users, ids)
    rows = _asked_visits(visits.where("inside"), owners, polygons, None)
    return rows.join(owners, "device").select(
        "id_user",
        F.col("device").alias("id_device"),
        F.col("polygon").alias("id_polygon"),
        F.col("enter_ts").alias("enter_date"),
    )


def currently_inside_pages(
    visits: DataFrame,
    users: DataFrame,
    polygons: list[int] | None = None,
    ids: list[int] | None = None,
    policy: SplitPolicy | None = None,
    page_rows: int = 10_000,
) -> DataFrame:
    """Nested by device: ``id_user, id_device, first_ordinal, collisions``."""
    owners = _owners(users, ids)
    rows = _asked_visits(visits.where("inside"), owners, polygons, ids)
    element = F.struct(F.col("polygon").alias("id_polygon"), F.col("enter_ts").alias("enter_date"))
    pages = _visit_pages(rows, element, policy, page_rows)
    return pages.join(owners, "device").select(
        "id_user", F.col("device").alias("id_device"), "first_ordinal", "collisions"
    )


def by_device(rows: DataFrame) -> DataFrame:
    """Final presentation order."""
    return rows.orderBy("id_device")
