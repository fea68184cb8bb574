import hashlib
import json

from conftest import START, rows
from pyspark.sql import functions as F

from geotrail.operators.transitions import distinct_messages, event_messages, read_messages
from geotrail.sources import locations as loc

GOOD = '{"id": 5, "point": {"x": -3.5, "y": 1.0E-5}, "timestamp": 1709995370493877}'
QUOTED = '{"id":"5","point":{"x":"1","y":2},"timestamp":"1709995370493877"}'
BAD = [
    "", "nonsense", '{"id": 5', '{"id": 5, "timestamp": 1}',
    '{"id": 5, "point": {"x": 1}, "timestamp": 1}',
    '{"point": {"x": 1, "y": 2}, "timestamp": 1}',
    '{"id": "five", "point": {"x": 1, "y": 2}, "timestamp": 1}',
    '{"id": 5, "point": {"x": 1, "y": 2}}',
]


def test_messages_are_accepted_or_set_aside(spark):
    texts = [GOOD, QUOTED, *BAD]
    parsed = loc.parse_records(spark.createDataFrame([(t,) for t in texts], "value string"))
    kept = loc.accepted(parsed).select("device", "x", "y", F.unix_micros("ts").alias("us"))
    assert rows(kept, "*") == [(5, -3.5, 1e-5, 1709995370493877), (5, 1.0, 2.0, 1709995370493877)]
    assert rows(loc.rejected(parsed), "value") == sorted([(t,) for t in BAD], key=repr)


def test_event_text_and_key(spark):
    events = spark.createDataFrame(
        [("enter", 3, 7, 1.5, -2.0, START), ("exit", 3, 7, 4.0, 1e-5, START)],
        "event_type string, polygon long, device long, x double, y double, event_ts timestamp",
    )
    millis = int(START.timestamp() * 1000)
    want = [
        '{"event_type": "enter", "polygon": 3, "device": 7, "in": true, '
        f'"collision_point_in": {{"x": 1.5, "y": -2.0}}, "collision_date_in": "{millis}"}}',
        '{"event_type": "exit", "polygon": 3, "device": 7, "in": false, '
        f'"collision_point_out": {{"x": 4.0, "y": 1.0E-5}}, "collision_date_out": "{millis}"}}',
    ]
    got = event_messages(events).collect()
    assert sorted(r.value for r in got) == sorted(want)
    assert all(r.key == hashlib.md5(r.value.encode()).hexdigest() for r in got)
    assert all(json.loads(r.value) for r in got)


def test_messages_read_back_and_repeats_collapse(spark):
    events = spark.createDataFrame(
        [("enter", 3, 7, True, 1.5, -2.0, START, None)] * 3
        + [("exit", 3, 7, False, 4.0, 1e-5, START, None)],
        "event_type string, polygon long, device long, in boolean, x double, y double,"
        " event_ts timestamp, seq long",
    )
    records = event_messages(events)
    assert rows(read_messages(distinct_messages(records)), *events.columns) == rows(
        events.distinct(), *events.columns
    )


def test_other_event_types_count_as_exits(spark):
    text = (
        '{"event_type": "left", "polygon": 1, "device": 2, "in": false,'
        ' "collision_point_out": {"x": 1, "y": 2}, "collision_date_out": "5"}'
    )
    record = spark.createDataFrame([(text, 9)], "value string, offset long")
    assert rows(read_messages(record), "event_type", "polygon", "x", "seq") == [("exit", 1, 1.0, 9)]
