"""Enter and exit events from a stream of locations.

Two plans, same events:

* ``micro_batches`` runs the batch operator on each micro-batch, with the last known point of
  a device as its starting state. A device with a third of the stream is split as in batch,
  and any fence set works. Use it for backlogs and for uneven traffic.
* ``stateful`` keeps the fences of each device in Spark's state store and needs no tables of its
  own. It takes any fence set. The rows of a device in one trigger come in chunks; where there are
  several, sorted runs wait in the state store and are merged, so that a device is never held whole.

Within a trigger points are taken by (time, arrival), across triggers by arrival; late points
are never dropped.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from geotrail.functions import messages, times
from geotrail.operators.containment import FenceIndex, collect_inside
from geotrail.operators.sizing import SplitPolicy
from geotrail.operators.transitions import collision_events, tracker_clock
from geotrail.sources import locations as loc
from geotrail.streaming.latest import last_points, tracker_state
from geotrail.streaming.store import BatchTable, KeyedTable

EVENT = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("polygon", T.LongType()),
        T.StructField("device", T.LongType()),
        T.StructField("in", T.BooleanType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)
# What the state function gives: times as whole microseconds.
CHANGE = T.StructType(
    [T.StructField("event_us", T.LongType()) if f.name == "event_ts" else f for f in EVENT]
)
# Rows of a stored run that are read at a time, and runs that are merged into a longer one.
BLOCK_ROWS = 1_000
FANIN = 16


def arriving_points(records: DataFrame) -> DataFrame:
    """Usable points of topic records on the tracker's clock. ``seq``, the order of arrival
    within a device, is the topic offset, or the time where there is no offset."""
    points = loc.accepted(loc.parse_records(loc.text_records(records)))
    seq = F.coalesce("offset", times.epoch_micros(F.col("ts")))
    return tracker_clock(points.select("device", seq.alias("seq"), "ts", "x", "y"))


# -- micro-batch plan ----------------------------------------------------------------------


def sets_of(points: DataFrame, index: FenceIndex) -> DataFrame:
    """Points, one per device, with their containing fences."""
    if index.strategy == "cells":
        return index.inside_sets(points)
    found = index.grid_matches(points, True, ["device"])
    return collect_inside(found, ["device"], ["ts", "seq"], ["x", "y"])


def track_batch(
    index: FenceIndex,
    latest: KeyedTable,
    events: BatchTable,
    policy: SplitPolicy | None = None,
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch`` on arriving points: appends the batch's events and moves
    the devices' state on. Replaying a batch gives the same tables."""
    policy = policy or SplitPolicy()

    def run(batch: DataFrame, number: int) -> None:
        points = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            split = policy.for_batch(points, ["device"], points.count())
            last = last_points(points).persist(StorageLevel.MEMORY_AND_DISK)
            known = latest.read(below=number, buckets=latest.needed(last)).join(
                last.select("device"), "device", "left_semi"
            )
            events.put(number, collision_events(points, index, split, known))
            latest.put(number, sets_of(last, index))
            last.unpersist()
        finally:
            points.unpersist()

    return run


def micro_batches(
    points: DataFrame,
    index: FenceIndex,
    root: str,
    policy: SplitPolicy | None = None,
    trigger: dict | None = None,
):
    """Start tracking into tables under ``root``, a folder every executor can reach."""
    spark = points.sparkSession
    run = track_batch(
        index, tracker_state(spark, f"{root}/latest"), event_table(spark, root), policy
    )
    return (
        points.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{root}/tracker-checkpoint")
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def event_table(spark: SparkSession, root: str) -> BatchTable:
    return BatchTable(spark, f"{root}/events", EVENT)


def event_stream(spark: SparkSession, root: str) -> DataFrame:
    """The events that ``micro_batches`` writes, as a stream: to publish them as messages. A
    batch that is written again is read again; readers go by the content of an event."""
    return spark.readStream.schema(EVENT).parquet(f"{root}/events/batch=*")


# -- state store plan ----------------------------------------------------------------------


def _changes_of(
    columns: list[str], enter: str, leave: str, block_rows: int, fanin: int
) -> StatefulProcessor:
    """The state function. It is built here from plain values, so that it travels to the
    workers whole and they need not have this package installed."""

    Point = tuple[int, int, float, float, list[int]]  # time, seq, x, y, fences

    class Changes(StatefulProcessor):
        """Events of a device, chunk by chunk; its state is the fences it is in."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.inside = handle.getMapState("inside", "polygon bigint", "since_us bigint")
            self.runs = handle.getMapState(
                "runs",
                "run bigint, block bigint",
                "at array<bigint>, seq array<bigint>, x array<double>, y array<double>,"
                " inside array<array<bigint>>",
            )

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            first, second = next(rows), next(rows, None)
            if second is None:
                yield from self.events(key[0], self.in_order(first))
                return
            levels: list[list[tuple[int, int]]] = []  # runs (number, blocks) by merges so far
            numbers = itertools.count()
            for frame in itertools.chain((first, second), rows):
                run, level = self.store(next(numbers), self.in_order(frame)), 0
                while True:
                    if level == len(levels):
                        levels.append([])
                    levels[level].append(run)
                    if len(levels[level]) < fanin:
                        break
                    run = self.store(next(numbers), self.merged(levels[level]))
                    levels[level], level = [], level + 1
            yield from self.events(key[0], self.merged([r for runs in levels for r in runs]))

        def in_order(self, frame: pd.DataFrame) -> list[Point]:
            fences = ([int(p) for p in inside] for inside in frame["inside"])
            columns = (frame[c].tolist() for c in ("at", "seq", "x", "y"))
            return sorted(zip(*columns, fences, strict=True))

        def store(self, run: int, points: Iterable[Point]) -> tuple[int, int]:
            points = iter(points)
            for block in itertools.count():
                part = list(itertools.islice(points, block_rows))
                if not part:
                    return run, block
                self.runs.updateValue((run, block), tuple(map(list, zip(*part, strict=True))))

        def stored(self, run: int, blocks: int) -> Iterator[Point]:
            """A run's points; what is read is forgotten."""
            for block in range(blocks):
                part = self.runs.getValue((run, block))
                self.runs.removeKey((run, block))
                yield from zip(*part, strict=True)

        def merged(self, runs: list[tuple[int, int]]) -> Iterator[Point]:
            return heapq.merge(*(self.stored(*run) for run in runs))

        def events(self, device: int, points: Iterable[Point]) -> Iterator[pd.DataFrame]:
            before = {fence: since for (fence,), (since,) in self.inside.iterator()}
            inside, found = dict(before), []
            # A point may come in several rows, one for each of its fences.
            for (at, seq, x, y), same in itertools.groupby(points, key=lambda p: p[:4]):
                now = {fence for point in same for fence in point[4]}
                for fence in sorted(inside.keys() - now):
                    del inside[fence]
                    found.append((leave, fence, device, False, x, y, at, seq))
                for fence in sorted(now - inside.keys()):
                    inside[fence] = at
                    found.append((enter, fence, device, True, x, y, at, seq))
                if len(found) >= block_rows:
                    yield pd.DataFrame(found, columns=columns)
                    found = []
            for fence in before.keys() - inside.keys():
                self.inside.removeKey((fence,))
            for fence, since in inside.items():
                if before.get(fence) != since:
                    self.inside.updateValue((fence,), (since,))
            yield pd.DataFrame(found, columns=columns)

        def close(self) -> None:
            pass

    return Changes()


def stateful(
    points: DataFrame, index: FenceIndex, block_rows: int = BLOCK_ROWS, fanin: int = FANIN
) -> DataFrame:
    """Streaming DataFrame of events.

    A task holds a chunk of a device's rows, and of the device's stored runs ``block_rows`` rows
    each, of at most ``fanin`` runs for each level of merging. Points of a device that agree in
    time and ``seq`` are taken by x, y."""
    if index.strategy == "cells":
        found = index.inside_sets(points)
    else:
        none, one = "cast(array() as array<bigint>)", "array(fence)"
        found = index.grid_matches(points, True, ["device"])
        found = found.selectExpr("*", f"if(fence is null, {none}, {one}) as inside")
    changes = _changes_of(CHANGE.fieldNames(), messages.ENTER, messages.EXIT, block_rows, fanin)
    events = (
        found.selectExpr(
            "cast(device as bigint) as device", "unix_micros(cast(ts as timestamp)) as at",
            "cast(seq as bigint) as seq", "x", "y", "inside",
        )
        .groupBy("device")
        .transformWithStateInPandas(changes, CHANGE, "append", "none")
    )
    micros = F.timestamp_micros("event_us").alias("event_ts")
    return events.select(*[micros if c == "event_ts" else c for c in EVENT.fieldNames()])
