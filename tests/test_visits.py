import random
from collections import defaultdict
from datetime import timedelta

import pytest
from conftest import START, rows
from pyspark.sql import functions as F

from geotrail.operators.sizing import SplitPolicy
from geotrail.operators.visits import visits

SCHEMA = (
    "event_type string, polygon long, device long, x double, y double,"
    " event_ts timestamp, seq long"
)


def simulate(events):
    """Oldest open visit closes first; an exit with nothing open does nothing."""
    waiting, done = defaultdict(list), []
    for kind, polygon, device, x, y, ts, seq in sorted(events, key=lambda e: (e[5], e[6])):
        if kind == "enter":
            waiting[device, polygon].append([device, polygon, ts, x, None, None])
        elif waiting[device, polygon]:
            visit = waiting[device, polygon].pop(0)
            done.append(tuple(visit[:4] + [ts, x]))
    rest = [tuple(v) for group in waiting.values() for v in group]
    return sorted(done + rest, key=repr)


def found(frame):
    return rows(frame, "device", "polygon", "enter_ts", "enter_point.x", "exit_ts", "exit_point.x")


def random_events(seed, count):
    """Not alternating: repeated enters and exits without an enter; one hot pair."""
    rnd = random.Random(seed)
    events = []
    for seq in range(count):
        hot = rnd.random() < 0.4
        device, polygon = (0, 0) if hot else (rnd.randrange(4), rnd.randrange(3))
        at = START + timedelta(seconds=seq // 2)
        kind = "enter" if rnd.random() < 0.5 else "exit"
        events.append((kind, polygon, device, float(seq), 0.0, at, seq))
    return events


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("target", [None, 30])
def test_any_event_sequence(spark, seed, target):
    events = random_events(seed, 600)
    policy = SplitPolicy().forced(target) if target else SplitPolicy().off()
    frame = visits(spark.createDataFrame(events, SCHEMA), policy)
    assert found(frame) == simulate(events)
    assert frame.where(F.col("inside") != F.col("exit_ts").isNull()).count() == 0


def test_hand_cases(spark):
    def at(second):
        return START + timedelta(seconds=second)

    events = [
        ("exit", 1, 1, 0.0, 0.0, at(0), 0),  # nothing open
        ("enter", 1, 1, 1.0, 0.0, at(1), 1),
        ("exit", 1, 1, 2.0, 0.0, at(2), 2),
        ("enter", 1, 1, 3.0, 0.0, at(3), 3),  # second visit, left open
        ("enter", 2, 1, 4.0, 0.0, at(4), 4),  # another fence
        ("exit", 2, 1, 5.0, 0.0, at(4), 5),  # same millisecond
    ]
    assert found(visits(spark.createDataFrame(events, SCHEMA))) == sorted(
        [
            (1, 1, at(1), 1.0, at(2), 2.0),
            (1, 1, at(3), 3.0, None, None),
            (1, 2, at(4), 4.0, at(4), 5.0),
        ],
        key=repr,
    )
