"""Enter and exit events from changes of containment.

For consecutive points of a device with containing sets A then B, the device left A \\ B and
entered B \\ A. The first point starts from the empty set, and a device that goes silent
stays where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotrail import schemas
from geotrail.functions import messages, times
from geotrail.operators import ordered
from geotrail.operators.containment import FenceIndex, collect_inside
from geotrail.operators.scan import Measures, scanned
from geotrail.operators.sizing import SplitPolicy

POINT_COLUMNS = ["device", "seq", "ts", "x", "y"]
ORDER = ["ts", "seq"]


def tracker_clock(points: DataFrame) -> DataFrame:
    """Cut ``ts`` to milliseconds, the clock of events and visits. Arrival number ``seq``
    orders points of the same millisecond."""
    kind = dict(points.dtypes)["ts"]
    return points.withColumn("ts", times.cut_to_millis(F.col("ts")).cast(kind))


def _with_known(
    sets: DataFrame, previous: DataFrame | None
) -> DataFrame:
    """``sets`` and, as halo rows before all others of their device, the points of earlier input
    with the sets they had then."""
    own = sets.withColumn(ordered.HALO, F.lit(False))
    if previous is None:
        return own
    lent = previous.select(*POINT_COLUMNS, "inside", F.lit(True).alias(ordered.HALO))
    return own.select(*POINT_COLUMNS, "inside", ordered.HALO).unionByName(lent)


def _sets_before(
    points: DataFrame, index: FenceIndex, policy: SplitPolicy, previous: DataFrame | None
) -> DataFrame:
    """Points with ``inside`` and ``_before``, the set of the point before it, or null."""
    rows = points.select(*POINT_COLUMNS)
    if not policy.applies_to(points, ["device"]):
        if index.strategy == "cells":
            sets = index.inside_sets(rows)
        else:
            found = index.grid_matches(rows, True, ["device", "seq", "ts"])
            sets = collect_inside(found, ["device"], ORDER, ["x", "y"])
        in_order = Window.partitionBy("device").orderBy(F.col(ordered.HALO).desc(), *ORDER)
        return _with_known(sets, previous).withColumn("_before", F.lag("inside").over(in_order))
    order, measures = ["_turn", *ORDER], Measures(lags={"_before": "inside"})
    ranges = policy.cut(points)
    turn = (~F.col(ordered.HALO)).cast("int")
    if index.strategy == "cells":
        # Bare points are dealt out, and sets are found where they then lie.
        none = F.lit(None).cast("array<bigint>")
        known = _with_known(rows.withColumn("inside", none), previous)
        known = known.withColumnRenamed("inside", "_known").withColumn("_turn", turn)

        def with_sets(dealt: DataFrame) -> DataFrame:
            found = index.inside_sets(dealt)
            return found.withColumn("inside", F.coalesce("_known", "inside"))

        return scanned(known, ["device"], order, measures, ranges, with_sets)
    found = index.grid_matches(rows, True, ["device", "seq", "ts"])
    sets = collect_inside(found, ["device", "seq"], ["ts"], ["x", "y"])
    sets = _with_known(sets, previous).withColumn("_turn", turn)
    return scanned(sets, ["device"], order, measures, ranges)


def collision_events(
    points: DataFrame,
    index: FenceIndex,
    policy: SplitPolicy | None = None,
    previous: DataFrame | None = None,
) -> DataFrame:
    """``event_type, polygon, device, in, x, y, event_ts, seq``, one row per change.

    ``points`` has ``device, seq, ts, x, y`` with (ts, seq) ordering the points of a device.
    ``previous``: last known point per device from earlier input, with the ``inside`` it had
    then; a device's sequence goes on from there. With the broadcast plan the only exchange is
    the one by device, or by ranges of device and time where a device is hot.
    """
    sets = _sets_before(points, index, policy or SplitPolicy(), previous)
    before = F.coalesce("_before", F.array().cast("array<bigint>"))
    # Left fences first, then entered ones; the position tells which.
    return (
        sets.withColumn("_before", before)
        .where(f"not {ordered.HALO} and inside <> _before")
        .selectExpr(
            *POINT_COLUMNS,
            "array_except(_before, inside) as _left",
            "array_except(inside, _before) as _joined",
        )
        .selectExpr(
            *POINT_COLUMNS,
            "size(_left) as _exits",
            "posexplode(concat(_left, _joined)) as (_at, polygon)",
        )
        .selectExpr(
            f"if(_at < _exits, '{messages.EXIT}', '{messages.ENTER}') as event_type",
            "polygon",
            "device",
            "_at >= _exits as in",
            "x",
            "y",
            "ts as event_ts",
            "seq",
        )
    )


def event_messages(events: DataFrame) -> DataFrame:
    """Events as ``key, value`` text records; the key is the content's MD5."""
    value = messages.event_json(
        F.col("event_type"),
        F.col("polygon"),
        F.col("device"),
        F.col("x"),
        F.col("y"),
        times.epoch_millis(F.col("event_ts")),
    )
    return events.select(value.alias("value")).select(
        messages.content_key(F.col("value")).alias("key"), "value"
    )


def distinct_messages(records: DataFrame) -> DataFrame:
    """One record per content, as a topic compacted on the content key keeps them. Duplicates
    are combined map-side, so a record repeated without end costs one row per task."""
    return records.select("key", "value").distinct()


def _usable(records: DataFrame) -> DataFrame:
    """Records with ``_usable``: whether all fields of an event can be read."""
    doc = F.from_json("value", schemas.COLLISION_MESSAGE)
    # The generator keeps Catalyst from parsing the text once per field.
    parsed = records.select("*", F.explode(F.array(doc)).alias("_doc"))
    fields = F.struct(*messages.event_fields("_doc"))
    parsed = parsed.select(*records.columns, F.explode(F.array(fields)).alias("_event"))
    needed = ("event_type", "polygon", "device", "x", "y", "event_ts")
    usable = F.lit(True)
    for name in needed:
        usable = usable & F.col(f"_event.{name}").isNotNull()
    return parsed.withColumn("_usable", usable)


def accepted_messages(records: DataFrame) -> DataFrame:
    """Records that hold an event."""
    return _usable(records).where("_usable").select(*records.columns)


def rejected_messages(records: DataFrame) -> DataFrame:
    """Records set aside because a field is missing or unreadable, with their text."""
    return _usable(records).where("not _usable").select(*records.columns)


def read_messages(records: DataFrame) -> DataFrame:
    """Event records back to columns; ``seq`` is the arrival number where there is one."""
    seq = F.col("offset") if "offset" in records.columns else F.lit(None).cast("bigint")
    # The generator keeps Catalyst from parsing the text once per field.
    doc = F.from_json("value", schemas.COLLISION_MESSAGE)
    return records.select(F.explode(F.array(doc)).alias("_doc"), seq.alias("seq")).select(
        *messages.event_fields("_doc"), "seq"
    )
