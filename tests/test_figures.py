"""Figures that stay, of streams and batch jobs."""

import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from geotrail.sources import locations as loc
from geotrail.sources import sample_tables as sample
from geotrail.streaming import figures, sinks

ONCE = {"availableNow": True}


@pytest.fixture
def table(spark, tmp_path):
    return figures.FigureTable(spark, str(tmp_path / "figures"))


def test_each_batch_of_a_stream_is_counted_once(spark, table, tmp_path):
    """Three files, one for each batch, and a second start that finds one more."""
    points = sample.locations(spark, FOLDER).withColumn("ts", F.col("ts").cast("timestamp"))
    source, parts = str(tmp_path / "in"), F.col("seq") % 4
    for part in range(3):
        points.where(parts == part).coalesce(1).write.mode("append").parquet(source)
    listener = figures.KeptFigures(table, {"here"})
    spark.streams.addListener(listener)
    try:
        for start in range(2):
            if start:
                points.where(parts == 3).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1)
            counted = sinks.counted(stream.parquet(source), "here")
            query = sinks.append_history(
                counted, str(tmp_path / "out"), str(tmp_path / "checkpoint"), ONCE
            )
            query.awaitTermination()
            listener.wait(query.runId)
    finally:
        spark.streams.removeListener(listener)
    want = points.agg(F.count("*"), F.min("ts"), F.max("ts")).first()
    got = table.totals().first()
    assert (got["rows"], got["first"], got["last"]) == tuple(want)
    assert got["batches"] == 4 and got["rows_per_second"] > 0
    assert {r["batch"] for r in table.read().collect()} == {0, 1, 2, 3}


def test_a_repeated_batch_replaces_its_figures(table):
    row = ("name", 5, None, None, 5, 1.0, None)
    table.put("run", 0, [row])
    table.put("run", 0, [row])
    table.put("run", 1, [row])
    assert [(r["batches"], r["rows"]) for r in table.totals().collect()] == [(2, 10)]


def test_a_batch_job_is_counted_as_written(spark, table, tmp_path):
    """The range exchange reads its input twice; the figures are those of the rows written."""
    points = sample.locations(spark, FOLDER)
    with figures.observed(table, "backfill", "history", "timestamp") as seen:
        loc.write_history(points, str(tmp_path / "history"), seen=seen)
    got = table.totals().first()
    assert got["rows"] == loc.read_history(spark, str(tmp_path / "history")).count() == 1000


def test_a_failed_job_leaves_no_figures(spark, table):
    with pytest.raises(ZeroDivisionError):
        with figures.observed(table, "run", "name", "ts"):
            1 / 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        table.read().collect()


def test_an_empty_batch_has_figures_without_times(spark, table, tmp_path):
    none = sample.locations(spark, FOLDER).where("false")
    with figures.observed(table, "empty", "history", "timestamp") as seen:
        loc.write_history(none, str(tmp_path / "history"), seen=seen)
    got = table.totals().first()
    assert (got["rows"], got["first"], got["last"]) == (0, None, None)


def test_filters_of_devices_skip_row_groups_in_order_of_arrival(spark, tmp_path):
    """Files as they land, each with ids from all over: a search reads those that have the id."""
    points = spark.range(40_000).selectExpr(
        "id % 4 + 4 * pmod(xxhash64(id), 5000) as device", "1D as x", "2D as y",
        "timestamp_seconds(id) as ts", "id % 4 as part",
    )
    source, out = str(tmp_path / "in"), str(tmp_path / "landing")
    points.repartition(4, "part").write.partitionBy("part").parquet(source)
    stream = spark.readStream.schema(points.schema).parquet(source)
    sinks.append_history(stream.drop("part"), out, str(tmp_path / "c"), ONCE).awaitTermination()
    wanted = points.first()["device"]
    found = loc.read_history(spark, out).where(F.col("id") == wanted)
    rows = found.collect()
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    read = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert len(rows) == points.where(F.col("device") == wanted).count()
    assert len(rows) <= read < 40_000, read
