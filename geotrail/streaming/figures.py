"""Figures of runs that stay: rows and their time range, of streams and of batch jobs, in a table.

A stream's figures come from a listener, one row for each micro-batch and name under which
``sinks.counted`` observes rows; a batch job's from an ``Observation``, one row for each write. A
row lies in a folder of its run and batch, so a batch that is repeated replaces its row: figures
added up over a table count every batch once.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

FIGURE = (
    "name string, rows bigint, first timestamp, last timestamp, read_rows bigint,"
    " seconds double, at timestamp"
)
PLACE = "run string, batch bigint"


class FigureTable:
    """Figures below ``path``, a folder every executor can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, run: str, batch: int, figures: list[tuple]) -> None:
        """Rows of FIGURE for a batch of a run, in place of earlier ones."""
        rows = self.spark.createDataFrame(figures, FIGURE).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/run={run}/batch={batch}")

    def read(self) -> DataFrame:
        """All figures with ``run`` and ``batch``."""
        return self.spark.read.schema(f"{FIGURE}, {PLACE}").parquet(self.path)

    def totals(self) -> DataFrame:
        """By run and name: batches, rows, time range, and rows for each second of work."""
        seconds = F.sum("seconds")
        return (
            self.read()
            .groupBy("run", "name")
            .agg(
                F.count(F.lit(1)).alias("batches"),
                F.sum("rows").alias("rows"),
                F.min("first").alias("first"),
                F.max("last").alias("last"),
                F.when(seconds > 0, F.sum("rows") / seconds).alias("rows_per_second"),
            )
        )


class KeptFigures(StreamingQueryListener):
    """Listener that writes the figures of each micro-batch of the queries it has been told of by
    their observed names; other queries are none of its business."""

    def __init__(self, table: FigureTable, names: set[str]):
        self.table, self.names = table, frozenset(names)
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()
        self.failures: list[str] = []

    def _end_of(self, run_id: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run_id, threading.Event())

    def wait(self, run_id: str, seconds: float = 60.0) -> None:
        """Until the figures of an ended query (``query.runId``) are written; events come late."""
        if not self._end_of(str(run_id)).wait(seconds):
            raise TimeoutError(f"no end of the query {run_id} was reported")
        if self.failures:
            raise RuntimeError(self.failures[0])

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seconds = progress.durationMs.get("triggerExecution", 0) / 1000
        now = datetime.now(timezone.utc)
        figures = [
            (name, row["rows"], row["first"], row["last"], progress.numInputRows, seconds, now)
            for name, row in progress.observedMetrics.items()
            if name in self.names
        ]
        if not figures:
            return
        # A listener that raises is only logged: what went wrong is kept for ``wait``.
        try:
            self.table.put(str(progress.id), progress.batchId, figures)
        except Exception as error:
            self.failures.append(f"figures of batch {progress.batchId}: {error}")

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()


@contextmanager
def observed(
    table: FigureTable, run: str, name: str, time: str
) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Keep the figures of a batch job as batch 0 of ``run``.

    Gives a function that counts rows and their range of ``time`` as they pass. It belongs right
    before the write: rows that are counted ahead of a range exchange pass once more for its
    sample. The job must have run when the block ends; one that fails leaves no figures."""
    seen, started = Observation(name), datetime.now(timezone.utc)
    at = F.col(time).cast("timestamp")
    yield lambda rows: rows.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.min(at).alias("first"), F.max(at).alias("last")
    )
    found, ended = seen.get, datetime.now(timezone.utc)
    seconds = (ended - started).total_seconds()
    figure = (name, found["rows"], found["first"], found["last"], found["rows"], seconds, ended)
    table.put(run, 0, [figure])
