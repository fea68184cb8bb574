"""The queries under comparison, over the sample tables, and their SQL counterparts.

Every query reads the whole tables. Results are flat and every computed column is named, so
that they can be compared as sets of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail import session
from geotrail.functions import geometry as geo
from geotrail.functions import messages, sql, times
from geotrail.operators import keyed, ordered
from geotrail.operators.containment import FenceIndex, prepared, resolution
from geotrail.operators.sizing import SplitPolicy
from geotrail.operators.transitions import (
    accepted_messages,
    collision_events,
    distinct_messages,
    event_messages,
    read_messages,
    rejected_messages,
    tracker_clock,
)
from geotrail.operators.visits import visits
from geotrail.plans import jobs, reads
from geotrail.sources import bucketed
from geotrail.sources import locations as loc
from geotrail.sources import sample_tables as sample
from geotrail.streaming import figures, latest, recorder, sinks, tracker

HISTORY_WINDOW = "2024-01-10;2d"
REPEATED_WINDOW = "2024-01-03T06:00;5h;1w;4"
VISIT_WINDOW = "2024-01-05T00:00:00;2024-01-20T12:00:00"
USER = 8
DEVICE = 7
OPEN_WINDOW = "2024-01-20T00:00:00"
CATEGORY = 4
LISTED_USERS = [i for i in range(1, 200) if i % 3]
WATCHED_POLYGONS = [0, 1, 2, 3, 5, 8, 13, 21]


def _index(spark: SparkSession, folder: str, strategy: str = "auto") -> FenceIndex:
    resolved = resolution(sample.locations(spark, folder))
    return FenceIndex(
        sample.outlined_fences(spark, folder), strategy, cells_per_fence=resolved
    )


def _tracked(spark: SparkSession, folder: str) -> DataFrame:
    return tracker_clock(sample.locations(spark, folder))


def _events(spark: SparkSession, folder: str, strategy: str = "auto") -> DataFrame:
    return collision_events(_tracked(spark, folder), _index(spark, folder, strategy))


def _visits(spark: SparkSession, folder: str) -> DataFrame:
    return visits(_events(spark, folder))


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return loc.history_rows(sample.locations(spark, folder)).drop("event_date")


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.latest_locations(sample.locations(spark, folder))


def _event_rows(events: DataFrame) -> DataFrame:
    return events.select("event_type", "polygon", "device", "in", "x", "y", "event_ts", "seq")


def _naive(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps without a zone, as the compared side has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# -- scans and scalar functions ------------------------------------------------------------


def locations_scan(spark, folder):
    """Messages written as JSON text and read back through the message parser."""
    points = sample.locations(spark, folder)
    text = points.select(
        "seq",
        messages.location_json(
            F.col("device"), F.col("x"), F.col("y"), times.epoch_micros(F.col("ts"))
        ).alias("value"),
    )
    parsed = loc.accepted(loc.parse_records(text))
    return _naive(parsed, "ts").select("seq", "device", "x", "y", "ts")


def polygons_scan(spark, folder):
    fences = sample.outlined_fences(spark, folder)
    return fences.select(
        "id", "category", "valid", "creation", F.size("rings").cast("bigint").alias("rings")
    )


def polygons_valid(spark, folder):
    fences = prepared(sample.outlined_fences(spark, folder))
    return fences.selectExpr(
        "fence as id_polygon",
        "cast(size(edges) as bigint) as edges",
        "box.x0 as min_x",
        "box.y0 as min_y",
        "box.x1 as max_x",
        "box.y1 as max_y",
    )


def users_scan(spark, folder):
    return keyed.chosen_users(sample.users(spark, folder), None)


def wkt_points(spark, folder):
    """Point text and back."""
    points = sample.locations(spark, folder).selectExpr(
        "seq", f"{geo.point_wkt('x', 'y')} as wkt"
    )
    parsed = points.selectExpr("seq", f"{geo.parse_point_wkt('wkt')} as p")
    return parsed.selectExpr("seq", "p.x as x", "p.y as y")


def wkt_polygons(spark, folder):
    """Polygon text to vertices, one row each."""
    return sample.outlined_fences(spark, folder).selectExpr("id", "posexplode(rings) as (ring, vs)").selectExpr(
        "id", "cast(ring as bigint) as ring", "posexplode(vs) as (vertex, v)"
    ).selectExpr("id", "ring", "cast(vertex as bigint) as vertex", "v.x as x", "v.y as y")


def ts_truncate_ms(spark, folder):
    points = sample.locations(spark, folder)
    return points.select(
        "seq",
        times.epoch_micros(F.col("ts")).alias("epoch_us"),
        times.micros_to_millis(times.epoch_micros(F.col("ts"))).alias("epoch_ms"),
        times.cut_to_millis(F.col("ts")).cast("timestamp_ntz").alias("ts_ms"),
    )


def reject_split(spark, folder):
    """Whole message stream with some messages damaged: cut off, without a point, or with a
    quoted id (which is fine)."""
    points = sample.locations(spark, folder)
    text = messages.location_json(
        F.col("device"), F.col("x"), F.col("y"), times.epoch_micros(F.col("ts"))
    )
    damaged = (
        F.when(F.col("seq") % 17 == 3, F.concat(F.lit('{"id": '), F.col("device").cast("string")))
        .when(
            F.col("seq") % 19 == 5,
            F.to_json(
                F.struct(
                    F.col("device").alias("id"), times.epoch_micros(F.col("ts")).alias("timestamp")
                )
            ),
        )
        .when(F.col("seq") % 23 == 7, F.regexp_replace(text, r'"id":(\d+)', r'"id":"$1"'))
        .otherwise(text)
    )
    # Both parts in one pass over the messages.
    parsed = loc.parse_records(points.select("seq", damaged.alias("value")))
    return parsed.select(
        "seq",
        "accepted",
        *(F.when(F.col("accepted"), F.col(c)).alias(c) for c in ("device", "x", "y")),
    )


def locations_keyed_json(spark, folder):
    """Topic records of the locations, decoded again."""
    records = loc.keyed_messages(sample.locations(spark, folder))
    return loc.parse_records(records).selectExpr(
        "cast(key as bigint) as key_device", "device", "x", "y", "micros as epoch_us"
    )


def history_flatten(spark, folder):
    return loc.history_rows(sample.locations(spark, folder))


# -- containment and events ----------------------------------------------------------------


def point_in_polygon_pairs(spark, folder):
    """Every (point, valid fence) pair whose containment flag is true."""
    pairs = _index(spark, folder).pairs(sample.locations(spark, folder))
    return pairs.select("seq", "device", F.col("fence").alias("polygon"))


def spatial_join_grid(spark, folder):
    """The same pairs by the shuffled grid join."""
    points = sample.locations(spark, folder)
    pairs = _index(spark, folder, "grid").pairs(points, ["seq"])
    return pairs.select("seq", "device", F.col("fence").alias("polygon"))


SQL_PAIRS = """
WITH fence AS (
  SELECT id, gt_edges(gt_rings(wkt)) AS edges FROM {fences} WHERE valid),
cover AS (
  SELECT id, edges, gt_cells(gt_box(edges), 8D) AS cells FROM fence),
cells AS (
  SELECT id, edges, explode(cells) AS cell FROM cover)
SELECT l.seq, l.device, c.id AS polygon
FROM (SELECT *, gt_cell(x, y, 8D) AS cell FROM {locations}) l JOIN cells c ON c.cell = l.cell
WHERE gt_contains(c.edges, l.x, l.y)
"""


def sql_point_in_polygon(spark, folder):
    """The pairs by a query in plain SQL over the two tables."""
    points, fences = sample.locations(spark, folder), sample.fences(spark, folder)
    sql.register(spark)
    return spark.sql(SQL_PAIRS, locations=points, fences=fences)


def inside_set(spark, folder):
    """Per point: how many fences contain it, and which, in order as text."""
    sets = _index(spark, folder).inside_sets(sample.locations(spark, folder))
    return sets.select(
        "seq",
        F.size("inside").cast("bigint").alias("fences"),
        F.array_join(F.array_sort("inside").cast("array<string>"), ",").alias("polygons"),
    )


def query_collision_events(spark, folder):
    return _event_rows(_events(spark, folder))


def collision_events_setdiff(spark, folder):
    """The events by the grid join and sets regrouped per point."""
    return _event_rows(_events(spark, folder, "grid"))


def collision_events_split(spark, folder):
    """The events with every device cut into chunks, as hot devices are."""
    policy = SplitPolicy().forced(target_rows=16)
    return _event_rows(
        collision_events(_tracked(spark, folder), _index(spark, folder), policy)
    )


def event_json_keyed(spark, folder):
    """Published event messages, decoded again; ``content_md5`` is over the integer fields."""
    decoded = read_messages(event_messages(_events(spark, folder)))
    epoch = times.epoch_millis(F.col("event_ts"))
    return decoded.select(
        "event_type",
        "polygon",
        "device",
        "in",
        "x",
        "y",
        epoch.alias("epoch_ms"),
        messages.content_key(
            F.concat_ws("|", "event_type", "polygon", "device", epoch.cast("string"))
        ).alias("content_md5"),
    )


def events_dedup(spark, folder):
    """Events delivered twice, kept once per content key."""
    once = event_messages(_events(spark, folder))
    kept = read_messages(distinct_messages(once.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))))
    return _naive(kept, "event_ts").select("event_type", "polygon", "device", "event_ts")


def _flat_visits(rows: DataFrame) -> DataFrame:
    return rows.select(
        "device",
        "polygon",
        "inside",
        F.col("enter_ts").alias("collision_date_in"),
        F.col("enter_point.x").alias("in_x"),
        F.col("enter_point.y").alias("in_y"),
        F.col("exit_ts").alias("collision_date_out"),
        F.col("exit_point.x").alias("out_x"),
        F.col("exit_point.y").alias("out_y"),
    )


def query_visits(spark, folder):
    return _flat_visits(_visits(spark, folder))


def visits_split(spark, folder):
    """The visits with every (device, fence) cut into chunks."""
    return _flat_visits(visits(_events(spark, folder), SplitPolicy().forced(target_rows=8)))


def current_polygon_set(spark, folder):
    current = keyed.current_fences(_visits(spark, folder))
    return current.select("device", F.explode("polygons").alias("polygon"))


# -- streams -------------------------------------------------------------------------------


def stream_events_micro_batch(spark, folder):
    """The locations replayed as a stream through the micro-batch tracker."""
    root = session.run_folder(spark)
    points = tracker_clock(sample.location_stream(spark, folder))
    run = {"availableNow": True}
    tracker.micro_batches(points, _index(spark, folder), root, trigger=run).awaitTermination()
    table = tracker.event_table(spark, root)
    return _event_rows(_naive(table.read(table.committed()), "event_ts"))


def _stateful_events(spark, folder, strategy: str) -> DataFrame:
    root = session.run_folder(spark)
    points = tracker_clock(sample.location_stream(spark, folder))
    events = tracker.stateful(points, _index(spark, folder, strategy).pin())
    writer = events.writeStream.format("parquet").option("path", f"{root}/events")
    writer = writer.option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.schema(tracker.EVENT).parquet(f"{root}/events")
    return _event_rows(_naive(stored, "event_ts"))


def stream_events_stateful(spark, folder):
    """The locations replayed through the tracker on the state store."""
    return _stateful_events(spark, folder, "auto")


def stream_events_stateful_grid(spark, folder):
    """The same with an index that is not broadcast."""
    return _stateful_events(spark, folder, "grid")


def _recorded(spark, root: str, path: str) -> recorder.VisitStore:
    """Visits of the event messages in the files of a folder, as far as they are there."""
    store = recorder.VisitStore(spark, f"{root}/visits")
    records = loc.text_records(loc.stream_message_files(spark, path))
    events = recorder.arriving_events(records)
    recorder.record_visits(
        events, store, f"{root}/visits-checkpoint", trigger={"availableNow": True}
    ).awaitTermination()
    return store


def stream_visits(spark, folder):
    """Event messages that come out of order, up to weeks late, and twice, through the recorder.

    A message's key says in which two of four deliveries it comes, so each delivery has events
    of all times. The recorder stops and starts again between them."""
    root = session.run_folder(spark)
    part = F.conv(F.substring("key", 1, 6), 16, 10).cast("int") % 4
    records = event_messages(_events(spark, folder)).withColumn("part", part)
    # Tracked once for all deliveries.
    records.select("part", "value").write.parquet(f"{root}/records")
    records = spark.read.parquet(f"{root}/records")
    for delivery in range(4):
        now = F.col("part").isin(delivery, (delivery + 1) % 4)
        records.where(now).select("value").write.mode("append").text(f"{root}/messages")
        store = _recorded(spark, root, f"{root}/messages")
    return _flat_visits(_naive(store.read(), "enter_ts", "exit_ts"))


def stream_pipeline(spark, folder):
    """From the stream of locations over published event messages to visits."""
    root, once = session.run_folder(spark), {"availableNow": True}
    points = tracker_clock(sample.location_stream(spark, folder))
    tracker.micro_batches(points, _index(spark, folder), root, trigger=once).awaitTermination()
    records = event_messages(tracker.event_stream(spark, root))
    published = sinks.publish_files(records, f"{root}/messages", f"{root}/sent", once)
    published.awaitTermination()
    store = _recorded(spark, root, f"{root}/messages")
    return _flat_visits(_naive(store.read(), "enter_ts", "exit_ts"))


def reject_split_events(spark, folder):
    """Event messages, some of them damaged: cut off, with an unreadable fence, without a time."""
    events = _events(spark, folder)
    value = messages.event_json(
        F.col("event_type"),
        F.col("polygon"),
        F.col("device"),
        F.col("x"),
        F.col("y"),
        times.epoch_millis(F.col("event_ts")),
    )
    damaged = (
        F.when(F.col("seq") % 17 == 3, F.substring(value, 1, 25))
        .when(F.col("seq") % 19 == 5, F.regexp_replace(value, r'"polygon": \d+', '"polygon": "x"'))
        .when(F.col("seq") % 23 == 7, F.regexp_replace(value, "collision_date", "date"))
        .otherwise(value)
    )
    records = events.select("seq", F.col("polygon").alias("of"), damaged.alias("value"))
    taken = accepted_messages(records).withColumn("accepted", F.lit(True))
    aside = rejected_messages(records).withColumn("accepted", F.lit(False))
    return taken.unionByName(aside).select(
        "seq", F.col("of").alias("polygon"), "accepted", F.length("value").cast("bigint").alias("size")
    )


def _latest_streamed(spark, folder):
    root = session.run_folder(spark)
    view = latest.latest_view(spark, f"{root}/latest")
    points = sample.location_stream(spark, folder)
    latest.record_latest(
        points, view, f"{root}/checkpoint", {"availableNow": True}
    ).awaitTermination()
    return _naive(view.read(), "ts")


def stream_latest(spark, folder):
    """The last arrival of each device, kept up by a stream, to the microsecond."""
    return _latest_streamed(spark, folder).select("device", "x", "y", "ts", "seq")


def latest_by_user_streamed(spark, folder):
    return reads.actual_locations(_latest_streamed(spark, folder), sample.users(spark, folder))


def history_settled(spark, folder):
    """History that lands from a stream and is brought into the sorted table day by day; one of
    the days twice."""
    root = session.run_folder(spark)
    points = sample.location_stream(spark, folder)
    landing, table = f"{root}/landing", f"{root}/history"
    once = {"availableNow": True}
    sinks.append_history(points, landing, f"{root}/checkpoint", once).awaitTermination()
    days = [
        str(r["event_date"])
        for r in loc.read_history(spark, landing).select("event_date").distinct().collect()
    ]
    loc.settle_days(spark, landing, table, days)
    loc.settle_days(spark, landing, table, sorted(days)[:1])
    return _naive(loc.read_history(spark, table), "timestamp")


def visits_stored(spark, folder):
    """The visit history from a stored table, of which only the days asked for are read."""
    root = session.run_folder(spark)
    _events(spark, folder).write.parquet(f"{root}/events")
    jobs.write_visits(spark, f"{root}/events", f"{root}/visits")
    stored = spark.read.parquet(f"{root}/visits")
    rows = reads.visit_history(stored, sample.users(spark, folder), VISIT_WINDOW)
    return _flat_points(rows)


# -- reads ---------------------------------------------------------------------------------


def latest_location(spark, folder):
    return _latest(spark, folder).select("device", "x", "y", "ts", "seq")


def device_user_map(spark, folder):
    return keyed.device_users(sample.users(spark, folder))


def latest_by_user(spark, folder):
    return reads.actual_locations(_latest(spark, folder), sample.users(spark, folder))


def latest_of_users(spark, folder):
    return reads.actual_locations(_latest(spark, folder), sample.users(spark, folder), LISTED_USERS)


def active_users(spark, folder):
    return reads.active_users(_latest(spark, folder), sample.users(spark, folder))


def history_by_device(spark, folder):
    return reads.device_history(_history(spark, folder), DEVICE)


def history_in_interval(spark, folder):
    return reads.in_window(_history(spark, folder), REPEATED_WINDOW)


def trajectory_one_user(spark, folder):
    return reads.user_trajectory(
        _history(spark, folder), sample.users(spark, folder), USER, HISTORY_WINDOW
    )


def trajectories_by_user(spark, folder):
    return reads.trajectories(
        _history(spark, folder), sample.users(spark, folder), HISTORY_WINDOW
    )


def trajectory_all(spark, folder):
    """One user's whole history."""
    return reads.user_trajectory(_history(spark, folder), sample.users(spark, folder), USER)


def trajectories_of_users(spark, folder):
    users = sample.users(spark, folder)
    return reads.trajectories(_history(spark, folder), users, HISTORY_WINDOW, LISTED_USERS)


def trajectory_pages(spark, folder):
    """Nested trajectories of the whole history, in pages of 16 points, unnested again."""
    pages = reads.trajectory_pages(
        _history(spark, folder), sample.users(spark, folder), "2024", page_rows=16
    )
    rows = pages.selectExpr(
        "id_user", "id_device", "first_ordinal", "posexplode(trajectory) as (n, t)"
    )
    return rows.selectExpr(
        "id_user",
        "id_device",
        "first_ordinal",
        "first_ordinal + n as ordinal",
        "t.timestamp as timestamp",
        "t.point.x as x",
        "t.point.y as y",
    )


def polygons_catalog(spark, folder):
    return reads.fence_catalogue(
        sample.fences(spark, folder), sample.categories(spark, folder), valid=True
    ).drop("fence")


def polygons_catalog_category(spark, folder):
    """Fences of one category that are not valid."""
    return reads.fence_catalogue(
        sample.fences(spark, folder), sample.categories(spark, folder), False, CATEGORY
    ).drop("fence")


def visits_history_open_end(spark, folder):
    rows = reads.visit_history(_visits(spark, folder), sample.users(spark, folder), OPEN_WINDOW)
    return _flat_points(rows)


def visits_history_paged(spark, folder):
    """Nested visits in pages of 16, unnested again."""
    pages = reads.visit_history_pages(
        _visits(spark, folder), sample.users(spark, folder), VISIT_WINDOW, page_rows=16
    )
    rows = pages.selectExpr(
        "time", "id_user", "id_device", "first_ordinal", "posexplode(collisions) as (n, v)"
    )
    rows = rows.selectExpr("time", "id_user", "id_device", "first_ordinal + n as ordinal", "v.*")
    return _flat_points(rows)


def currently_inside_paged(spark, folder):
    pages = reads.currently_inside_pages(
        _visits(spark, folder), sample.users(spark, folder), page_rows=2
    )
    return pages.selectExpr("id_user", "id_device", "inline(collisions)")


def currently_inside_listed(spark, folder):
    return reads.currently_inside(
        _visits(spark, folder), sample.users(spark, folder), WATCHED_POLYGONS, LISTED_USERS
    )


def visits_history(spark, folder):
    rows = reads.visit_history(_visits(spark, folder), sample.users(spark, folder), VISIT_WINDOW)
    return _flat_points(rows)


def visits_history_restricted(spark, folder):
    """The visit history with lists of fences and users given."""
    rows = reads.visit_history(
        _visits(spark, folder),
        sample.users(spark, folder),
        VISIT_WINDOW,
        WATCHED_POLYGONS,
        LISTED_USERS,
    )
    return _flat_points(rows)


def _flat_points(rows: DataFrame) -> DataFrame:
    for name in ("enter_point", "exit_point"):
        rows = rows.withColumns(
            {f"{name}_x": F.get(name, F.lit(0)), f"{name}_y": F.get(name, F.lit(1))}
        ).drop(name)
    return rows


def currently_inside(spark, folder):
    return reads.currently_inside(_visits(spark, folder), sample.users(spark, folder))


def _ranked(df: DataFrame, order: list[str], stored: bool = False) -> DataFrame:
    """In many ranges, as large tables are."""
    return ordered.ranked(df, order, SplitPolicy().forced(target_rows=64), stored=stored)


def history_ordered(spark, folder):
    """The history in order of device and time, with each row's place in it."""
    points = sample.locations(spark, folder)
    found = _ranked(points, ["device", "ts", "seq"], stored=True)
    return found.select("position", "device", "ts", "x", "y")


def visits_ordered(spark, folder):
    """The visits in order of device, time and fence, with each one's place."""
    rows = _visits(spark, folder).select("device", "polygon", "enter_ts", "exit_ts")
    return _ranked(rows, ["device", "enter_ts", "polygon"])


def stream_figures(spark, folder):
    """What the kept figures of a stream and of a batch job say about the locations."""
    root = session.run_folder(spark)
    table = figures.FigureTable(spark, f"{root}/figures")
    listener = figures.KeptFigures(table, {"streamed"})
    spark.streams.addListener(listener)
    try:
        points = sinks.counted(sample.location_stream(spark, folder), "streamed")
        query = sinks.append_history(
            points, f"{root}/history", f"{root}/checkpoint", {"availableNow": True}
        )
        query.awaitTermination()
        listener.wait(query.runId)
    finally:
        spark.streams.removeListener(listener)
    with figures.observed(table, "batch", "written", "timestamp") as seen:
        loc.write_history(sample.locations(spark, folder), f"{root}/written", seen=seen)
    return _naive(table.totals(), "first", "last").select("name", "rows", "first", "last")


def visits_of_users_bucketed(spark, folder):
    """Users, their latest location and their visits, from tables that lie by device; one of five
    devices counts as hot."""
    root = session.run_folder(spark)
    prefix = "run_" + root.rsplit("-", 1)[-1]
    tables = bucketed.BucketedTables(spark, f"{root}/bucketed", prefix, buckets=8)
    owners = keyed.device_users(sample.users(spark, folder))
    tables.write("owners", owners, [], SplitPolicy().off())
    now = _latest(spark, folder).select("device", "x", "y")
    tables.write("latest", now, [], SplitPolicy().off())
    rows = _flat_visits(_visits(spark, folder)).select(
        "device", "polygon", "inside", "collision_date_in", "collision_date_out"
    )
    typical = rows.groupBy("device").count().selectExpr("percentile(count, 0.8)").first()[0]
    policy = SplitPolicy(max_ranges=1 << 20).forced(target_rows=int(typical))
    tables.write("visits", rows, ["collision_date_in", "polygon"], policy)
    for name in ("owners", "latest"):
        tables.check_unique(name)
    return tables.joined("visits", "owners", "latest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "locations_scan": locations_scan,
    "polygons_scan": polygons_scan,
    "polygons_valid": polygons_valid,
    "users_scan": users_scan,
    "wkt_points": wkt_points,
    "wkt_polygons": wkt_polygons,
    "ts_truncate_ms": ts_truncate_ms,
    "reject_split": reject_split,
    "locations_keyed_json": locations_keyed_json,
    "history_flatten": history_flatten,
    "point_in_polygon_pairs": point_in_polygon_pairs,
    "spatial_join_grid": spatial_join_grid,
    "sql_point_in_polygon": sql_point_in_polygon,
    "history_ordered": history_ordered,
    "visits_ordered": visits_ordered,
    "stream_figures": stream_figures,
    "visits_of_users_bucketed": visits_of_users_bucketed,
    "inside_set": inside_set,
    "collision_events": query_collision_events,
    "collision_events_setdiff": collision_events_setdiff,
    "collision_events_split": collision_events_split,
    "event_json_keyed": event_json_keyed,
    "events_dedup": events_dedup,
    "visits": query_visits,
    "visits_split": visits_split,
    "current_polygon_set": current_polygon_set,
    "stream_events_micro_batch": stream_events_micro_batch,
    "stream_events_stateful": stream_events_stateful,
    "stream_events_stateful_grid": stream_events_stateful_grid,
    "stream_visits": stream_visits,
    "stream_pipeline": stream_pipeline,
    "reject_split_events": reject_split_events,
    "stream_latest": stream_latest,
    "latest_by_user_streamed": latest_by_user_streamed,
    "history_settled": history_settled,
    "visits_stored": visits_stored,
    "latest_of_users": latest_of_users,
    "trajectory_all": trajectory_all,
    "trajectories_of_users": trajectories_of_users,
    "polygons_catalog_category": polygons_catalog_category,
    "visits_history_open_end": visits_history_open_end,
    "visits_history_paged": visits_history_paged,
    "currently_inside_paged": currently_inside_paged,
    "currently_inside_listed": currently_inside_listed,
    "latest_location": latest_location,
    "device_user_map": device_user_map,
    "latest_by_user": latest_by_user,
    "active_users": active_users,
    "history_by_device": history_by_device,
    "history_in_interval": history_in_interval,
    "trajectory_one_user": trajectory_one_user,
    "trajectories_by_user": trajectories_by_user,
    "trajectory_pages": trajectory_pages,
    "polygons_catalog": polygons_catalog,
    "visits_history": visits_history,
    "visits_history_restricted": visits_history_restricted,
    "currently_inside": currently_inside,
}

