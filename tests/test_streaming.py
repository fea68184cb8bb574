"""Streams replayed from files give the batch results, also after restarts and repeats."""

from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import START, rows
from pyspark.sql import functions as F

from geotrail.operators import keyed
from geotrail.operators.containment import FenceIndex
from geotrail.operators.sizing import SplitPolicy
from geotrail.operators.transitions import collision_events, event_messages, tracker_clock
from geotrail.operators.visits import visits
from geotrail.sources import locations as loc
from geotrail.sources import sample_tables as sample
from geotrail.streaming import recorder, sinks, tracker
from geotrail.streaming import latest as latest_
from geotrail.streaming.latest import tracker_state

ONCE = {"availableNow": True}
EVENT = ["event_type", "polygon", "device", "in", "x", "y", "event_ts"]
VISIT = ["device", "polygon", "inside", "enter_ts", "enter_point.x", "exit_ts", "exit_point.x"]


@pytest.fixture(scope="module")
def index(spark, folder):
    return FenceIndex(sample.outlined_fences(spark, folder)).pin()


@pytest.fixture(scope="module")
def located(spark, folder):
    points = sample.locations(spark, folder)
    return points.withColumn("ts", F.col("ts").cast("timestamp")).cache()


@pytest.fixture(scope="module")
def batch_events(located, index):
    return collision_events(tracker_clock(located), index).cache()


@pytest.fixture
def messages(located, tmp_path):
    """Folder to which parts of the message stream are added in order of time."""
    folder = str(tmp_path / "messages")
    cut = located.withColumn("part", F.expr("ntile(3) over (order by ts)")).cache()

    def add(part):
        rows_ = loc.keyed_messages(cut.where(F.col("part") == part)).select("value")
        rows_.coalesce(1).write.mode("append").text(folder)
        return folder

    return add


def arriving(spark, folder):
    return tracker.arriving_points(loc.stream_message_files(spark, folder, 1))


@pytest.mark.parametrize("policy", [None, SplitPolicy().forced(target_rows=20)])
def test_micro_batches_with_a_restart(spark, messages, index, located, batch_events, tmp_path, policy):
    root = str(tmp_path / "out")
    for part in (1, 2, 3):  # every part is a new start of the query
        source = arriving(spark, messages(part))
        query = tracker.micro_batches(source, index, root, policy, ONCE)
        query.awaitTermination()
        assert sinks.run_figures(query)["rows"] >= 333
    table = tracker.event_table(spark, root)
    assert rows(table.read(table.committed()), *EVENT) == rows(batch_events, *EVENT)
    latest = tracker_state(spark, f"{root}/latest").read()
    want = keyed.latest_locations(tracker_clock(located))
    assert rows(latest, "device", "x", "y", "ts") == rows(want, "device", "x", "y", "ts")


def test_state_store_plan_with_a_restart(spark, messages, index, batch_events, tmp_path):
    out, checkpoint = str(tmp_path / "events"), str(tmp_path / "checkpoint")
    for part in (1, 2, 3):
        events = tracker.stateful(arriving(spark, messages(part)), index)
        writer = events.writeStream.format("parquet").option("path", out)
        writer.option("checkpointLocation", checkpoint).trigger(**ONCE).start().awaitTermination()
    assert rows(spark.read.parquet(out), *EVENT) == rows(batch_events, *EVENT)


@pytest.mark.parametrize("strategy", ["cells", "grid"])
def test_state_store_plan_with_chunks_of_a_device(
    spark, folder, messages, batch_events, tmp_path, strategy
):
    """Chunks of three rows, runs merged two by two, in blocks of two; with either index."""
    out, checkpoint = str(tmp_path / "events"), str(tmp_path / "checkpoint")
    index = FenceIndex(sample.outlined_fences(spark, folder), strategy).pin()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for part in (1, 2, 3):
            points = arriving(spark, messages(part))
            events = tracker.stateful(points, index, block_rows=2, fanin=2)
            writer = events.writeStream.format("parquet").option("path", out)
            writer = writer.option("checkpointLocation", checkpoint).trigger(**ONCE)
            writer.start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows(spark.read.parquet(out), *EVENT) == rows(batch_events, *EVENT)


def test_runs_of_a_device_are_merged_in_the_state_store():
    """One device, rows in no order, in many chunks: at most one chunk and a block of each run are
    held, nothing stays behind, and the order is that of all rows."""

    class Store(dict):
        def iterator(self):
            return ((k, self[k]) for k in sorted(self))

        def getValue(self, k):
            return self[k]

        def updateValue(self, k, v):
            assert len(v[0]) <= 4 if len(v) == 5 else True
            self[k] = v

        def removeKey(self, k):
            del self[k]

    changes = tracker._changes_of(tracker.CHANGE.fieldNames(), "enter", "exit", 4, 3)
    changes.inside, changes.runs = Store({(9,): (1,)}), Store()
    random = np.random.default_rng(1)
    places = random.permutation(500)
    frame = pd.DataFrame(
        {
            "at": places // 5, "seq": places, "x": 0.0, "y": 0.0,
            "inside": [list(range(int(p) % 4)) for p in places],
        }
    )
    chunks = (frame.iloc[i : i + 7] for i in range(0, 500, 7))
    got = pd.concat(changes.handleInputRows((5,), chunks, None))
    whole = tracker._changes_of(tracker.CHANGE.fieldNames(), "enter", "exit", 1000, 3)
    whole.inside, whole.runs = Store({(9,): (1,)}), Store()
    want = pd.concat(whole.handleInputRows((5,), iter([frame]), None))
    assert got.values.tolist() == want.values.tolist()
    assert got["seq"].is_monotonic_increasing and got.iloc[0]["polygon"] == 9
    assert not changes.runs and changes.inside == whole.inside


def test_a_replayed_batch_changes_nothing(spark, index, located, batch_events, tmp_path):
    latest = tracker_state(spark, str(tmp_path / "latest"), fanout=2)
    table = tracker.event_table(spark, str(tmp_path))
    run = tracker.track_batch(index, latest, table)
    cut = tracker_clock(located).withColumn("part", F.expr("ntile(4) over (order by ts)")).cache()
    for number in (0, 1, 1, 2, 2, 3):
        run(cut.where(F.col("part") == number + 1).drop("part"), number)
    assert rows(table.read(table.committed()), *EVENT) == rows(batch_events, *EVENT)
    assert (1, 1) in latest.live()
    want = keyed.latest_locations(tracker_clock(located))
    assert rows(latest.read(), "device", "x", "seq") == rows(want, "device", "x", "seq")


def test_a_late_point_counts_when_it_arrives(spark, fences, tmp_path):
    index = FenceIndex(fences((1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))")))
    table = tracker.event_table(spark, str(tmp_path))
    run = tracker.track_batch(index, tracker_state(spark, str(tmp_path / "latest")), table)

    def batch(seq, second, x):
        return spark.createDataFrame(
            [(1, seq, START + timedelta(seconds=second), x, 5.0)],
            "device long, seq long, ts timestamp, x double, y double",
        )

    run(batch(0, 100, 5.0), 0)
    run(batch(1, 50, 50.0), 1)  # earlier time, later arrival: leaves
    got = table.read(table.committed())
    assert rows(got, "event_type", "seq") == [("enter", 0), ("exit", 1)]


def test_visits_from_published_messages(spark, batch_events, tmp_path):
    """Messages in three files, with one file delivered twice."""
    folder, root = str(tmp_path / "collisions"), str(tmp_path / "visits")
    cut = batch_events.withColumn("part", F.expr("ntile(3) over (order by event_ts, seq, in)"))
    store = recorder.VisitStore(spark, root)
    for part in (1, 2, 2, 3):
        records = event_messages(cut.where(F.col("part") == part)).select("value")
        records.coalesce(1).write.mode("append").text(folder)
        source = loc.text_records(loc.stream_message_files(spark, folder, 1))
        events = recorder.arriving_events(source)
        recorder.record_visits(events, store, str(tmp_path / "cp"), trigger=ONCE).awaitTermination()
    assert rows(store.read(), *VISIT) == rows(visits(batch_events), *VISIT)


@pytest.mark.parametrize("policy", [None, SplitPolicy().forced(target_rows=20)])
def test_visit_batches_replayed(spark, batch_events, tmp_path, policy):
    store = recorder.VisitStore(spark, str(tmp_path))
    run = recorder.record_batch(store, policy)
    cut = batch_events.withColumn("part", F.expr("ntile(3) over (order by event_ts, seq, in)")).cache()
    for number in (0, 1, 1, 2):
        run(cut.where(F.col("part") == number + 1).drop("part"), number)
    assert rows(store.read(), *VISIT) == rows(visits(batch_events), *VISIT)


def test_history_and_rejects(spark, tmp_path):
    good = '{"id": 1, "point": {"x": 1.0, "y": 2.0}, "timestamp": 1709995370493877}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(f"{good}\nbroken\n")
    parsed = loc.parse_records(loc.stream_message_files(spark, str(tmp_path / "in")))
    kept, aside = str(tmp_path / "history"), str(tmp_path / "rejected")
    points = sinks.counted(sinks.with_event_time(loc.accepted(parsed)), "figures")
    query = sinks.append_history(points, kept, str(tmp_path / "c1"), ONCE)
    query.awaitTermination()
    assert query.lastProgress["observedMetrics"]["figures"]["rows"] == 1
    sinks.keep_rejected(parsed, aside, str(tmp_path / "c2"), ONCE).awaitTermination()
    stored = loc.read_history(spark, kept).withColumn("us", F.unix_micros("timestamp"))
    assert rows(stored, "id", "point_x", "us") == [(1, 1.0, 1709995370493877)]
    assert rows(spark.read.parquet(aside), "value") == [("broken",)]
    sinks.print_points(points, str(tmp_path / "c3"), ONCE).awaitTermination()


# -- what the sample tables do not have ----------------------------------------------------


def _event(kind, second, x, seq=None, device=1, polygon=7):
    at = START + timedelta(seconds=second)
    return (kind, polygon, device, kind == "enter", float(x), 0.0, at, seq)


def spans(found):
    """(second of enter, second of exit, x of enter) of visits."""

    def second(at):
        return None if at is None else (at - START).total_seconds()

    rows_ = [(second(r.enter_ts), second(r.exit_ts), r.enter_point.x) for r in found.collect()]
    return sorted(rows_, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))


@pytest.fixture
def recorded(spark, tmp_path):
    """Records batches of events and gives back (enter, exit) seconds of the visits."""
    store = recorder.VisitStore(spark, str(tmp_path / "visits"), fanout=2)
    run, number = recorder.record_batch(store), iter(range(100))

    def record(*batches):
        for batch in batches:
            run(spark.createDataFrame(list(batch), tracker.EVENT), next(number))
        return spans(store.read())

    return record


def test_an_exit_before_its_enter(recorded):
    assert recorded([_event("exit", 9, 2)]) == []
    assert recorded([_event("enter", 5, 1)]) == [(5, 9, 1)]
    # And it stays closed when more comes.
    assert recorded([_event("enter", 20, 3)]) == [(5, 9, 1), (20, None, 3)]


def test_an_event_hours_late(recorded):
    recorded([_event("enter", 100_000, 1)], [_event("exit", 100_010, 2)])
    late = [_event("enter", 1_000, 3), _event("exit", 1_010, 4)]
    assert recorded(late) == [(1_000, 1_010, 3), (100_000, 100_010, 1)]


def test_a_late_enter_takes_over_a_later_exit(recorded):
    recorded([_event("enter", 50, 1), _event("exit", 60, 2)])
    # The oldest open visit is closed first.
    assert recorded([_event("enter", 40, 3)]) == [(40, 60, 3), (50, None, 1)]
    assert recorded([_event("exit", 45, 4)]) == [(40, 45, 3), (50, 60, 1)]


def test_repeated_events(recorded):
    first = _event("enter", 5, 1)
    assert recorded([first], [first], [first, first]) == [(5, None, 1)]
    leave = _event("exit", 9, 2)
    assert recorded([leave], [first, leave]) == [(5, 9, 1)]


def test_a_second_enter_in_the_same_millisecond(recorded):
    got = recorded([_event("enter", 5, 1, 0), _event("exit", 5, 2, 1), _event("enter", 5, 3, 2)])
    assert got == [(5, 5, 1), (5, None, 3)]


def test_any_order_and_cut_gives_the_batch_result(spark, recorded):
    import random

    r = random.Random(4)
    events = [
        _event(r.choice(["enter", "exit"]), t, t, t, device=r.randint(1, 3), polygon=r.randint(1, 2))
        for t in range(80)
    ]
    frame = spark.createDataFrame(events, tracker.EVENT)
    want = spans(visits(frame))
    shuffled = events + r.sample(events, 20)
    r.shuffle(shuffled)
    assert recorded(*[shuffled[i : i + 25] for i in range(0, 100, 25)]) == want


def test_events_that_change_visits_of_settled_days(spark, tmp_path):
    import random

    r = random.Random(6)
    hours = [3600 * 7 * t for t in range(48)]
    events = [
        _event(r.choice(["enter", "exit"]), t, n, n, device=1, polygon=r.randint(1, 2))
        for n, t in enumerate(hours)
    ]
    want = spans(visits(spark.createDataFrame(events, tracker.EVENT)))
    # Every fourth event comes when its day has been settled.
    late = events[1::4]
    batches = [events[i : i + 6] for i in range(0, 48, 6)]
    batches = [[e for e in b if e not in late] for b in batches] + [late[:6], late[6:], late[:2]]
    store = recorder.VisitStore(spark, str(tmp_path / "visits"), fanout=2, settle_after=3600)
    run = recorder.record_batch(store)
    for number, batch in enumerate(batches):
        run(spark.createDataFrame(batch, tracker.EVENT), number)
    assert spans(store.read()) == want
    assert store.rows._read_settled(None).count() >= 5


def test_unreadable_events_are_set_aside(spark, tmp_path):
    from geotrail.operators.transitions import accepted_messages, rejected_messages

    good = event_messages(spark.createDataFrame([_event("enter", 5, 1)], tracker.EVENT))
    value = good.first()["value"]
    bad = [value[:30], value.replace('"polygon": 7', '"polygon": "x"'), "", None, "{}"]
    records = spark.createDataFrame([(v,) for v in [value, *bad]], "value string")
    assert [r.value for r in accepted_messages(records).collect()] == [value]
    aside = [r.value for r in rejected_messages(records).collect()]
    assert sorted(aside, key=str) == sorted(bad, key=str)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("broken\n" + value + "\n")
    source = loc.text_records(loc.stream_message_files(spark, str(tmp_path / "in")))
    out = str(tmp_path / "aside")
    sinks.keep_rejected_events(source, out, str(tmp_path / "cp"), ONCE).awaitTermination()
    assert rows(spark.read.parquet(out), "value") == [("broken",)]


def test_the_latest_view_keeps_arrival_and_microseconds(spark, tmp_path):
    view = latest_.latest_view(spark, str(tmp_path), fanout=2)
    run = latest_.latest_batch(view)

    def batch(*points):
        return spark.createDataFrame(
            [(1, seq, START + timedelta(microseconds=us), 0.0, 0.0) for seq, us in points],
            "device long, seq long, ts timestamp, x double, y double",
        )

    run(batch((0, 493_877), (1, 20)), 0)  # the later arrival has the earlier time
    assert rows(view.read(), "seq", "ts") == [(1, START + timedelta(microseconds=20))]
    run(batch((2, 7)), 1)
    assert rows(view.read(), "seq") == [(2,)]


def test_fences_that_change_under_a_running_index(spark, tmp_path):
    """An index answers from the fences as they were when it was made."""
    from geotrail.sources.dimensions import with_outline

    path = str(tmp_path / "fences")

    def put(wkt):
        row = [(1, wkt, START, True, 1)]
        spark.createDataFrame(
            row, "id long, wkt string, creation timestamp, valid boolean, category long"
        ).write.mode("overwrite").parquet(path)

    put("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))")
    index = FenceIndex(with_outline(spark.read.parquet(path)))
    put("POLYGON ((0 50, 10 50, 10 60, 0 60, 0 50))")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 55.0)], "seq long, x double, y double")
    assert rows(index.pairs(points), "seq", "fence") == [(1, 1)]


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from geotrail import session

    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Cluster:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.run_folder(Cluster())


def test_lost_offsets_stop_a_query_unless_told_otherwise():
    from geotrail.sources import kafka

    assert kafka.source_options("h", "t")["failOnDataLoss"] == "true"
    assert kafka.source_options("h", "t", skip_lost=True)["failOnDataLoss"] == "false"


def test_settling_a_day_leaves_the_others(spark, tmp_path, located):
    landing, table = str(tmp_path / "landing"), str(tmp_path / "table")
    loc.write_history(located, landing)
    days = sorted({str(r.ts.date()) for r in located.select("ts").collect()})
    loc.settle_days(spark, landing, table, days)
    loc.settle_days(spark, landing, table, days[:1])
    columns = ["id", "point_x", "point_y", "timestamp"]
    assert rows(loc.read_history(spark, table), *columns) == rows(
        loc.read_history(spark, landing), *columns
    )
