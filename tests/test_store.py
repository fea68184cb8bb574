"""Tables that batches keep up: levels, settled days, replays, and what a batch writes."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotrail.streaming.store import KeyedTable

SCHEMA = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("version", T.LongType()),
        T.StructField("ended", T.TimestampType()),
    ]
)


def table(spark, root, **settings):
    return KeyedTable(spark, str(root), SCHEMA, ["key"], "key", **{"buckets": 4, "fanout": 2, **settings})


def rows(spark, pairs, day=None):
    ended = F.lit(day).cast("timestamp")
    return spark.createDataFrame(pairs, "key long, version long").withColumn("ended", ended).coalesce(1)


def found(df):
    return sorted((r.key, r.version) for r in df.collect())


def test_the_last_version_wins_on_every_level_and_in_replays(spark, tmp_path):
    r, kept, held = random.Random(1), {}, table(spark, tmp_path)
    for batch in range(11):
        changes = {r.randint(0, 9): 100 * batch + n for n in range(3)}
        if batch in (3, 4):
            continue  # batches without rows are not put
        for _ in range(2 if batch in (6, 8) else 1):
            # A replayed batch finds what it found before.
            assert found(held.read(below=batch)) == sorted(kept.items())
            held.put(batch, rows(spark, list(changes.items())))
        kept.update(changes)
    assert found(held.read()) == sorted(kept.items())
    assert found(held.read(buckets=held.needed(rows(spark, [(4, 0)])))) and len(held.live()) <= 6
    assert max(level for level, _ in held.live()) >= 2


def test_the_layout_stays_with_the_table(spark, tmp_path):
    table(spark, tmp_path, buckets=4).put(0, rows(spark, [(k, k) for k in range(20)]))
    other = table(spark, tmp_path, buckets=64, fanout=8)
    assert other.layout() == (4, 2)
    assert found(other.read(buckets=other.needed(rows(spark, [(7, 0)])))).count((7, 7)) == 1


def written_by(root, put):
    """Bytes of the files that a batch adds."""
    def sizes():
        return {
            os.path.join(d, f): os.path.getsize(os.path.join(d, f))
            for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")
        }

    before = sizes()
    put()
    return sum(size for path, size in sizes().items() if path not in before)


def test_bytes_written_do_not_grow_with_the_table(spark, tmp_path):
    held = table(spark, tmp_path, buckets=1, day="cast(ended as date)")
    settled, cost = F.col("ended").isNotNull(), []
    for batch in range(24):
        fresh = rows(spark, [(1000 * batch + n, random.Random(1000 * batch + n).getrandbits(60)) for n in range(1000)], "2024-03-01")
        cost.append(written_by(tmp_path, lambda: held.put(batch, fresh, settled)))
    # Each row is written at most once for a level below the settling one, and once by its day.
    early, late = sum(cost[8:16]), sum(cost[16:24])
    assert late <= 1.1 * early and late <= 3.5 * 8 * cost[0]
    assert held.read().count() == 24_000


def test_settled_rows_are_read_from_their_day_on_and_can_change(spark, tmp_path):
    held = table(spark, tmp_path, day="cast(ended as date)")
    for batch, day in enumerate(["2024-03-01", "2024-03-01", "2024-03-02", "2024-03-02", "2024-03-05"]):
        held.put(batch, rows(spark, [(batch, batch)], day), F.col("ended") < "2024-03-04")
    assert sorted(os.listdir(tmp_path / "settled"))[-2:] == ["day=2024-03-01", "day=2024-03-02"]
    assert found(held.read()) == [(n, n) for n in range(5)]
    assert found(held.read(since="2024-03-02")) == [(2, 2), (3, 3), (4, 4)]
    marked = held.read(mark="old").collect()
    assert {r.key: r.old for r in marked} == {0: True, 1: True, 2: True, 3: True, 4: False}
    held.put(5, rows(spark, [(0, 50)], None))
    assert found(held.read())[0] == (0, 50)


@pytest.mark.parametrize("below", [None, 3])
def test_an_empty_table(spark, tmp_path, below):
    assert found(table(spark, tmp_path, day="cast(ended as date)").read(below, [0], "2024-01-01")) == []
