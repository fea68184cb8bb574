"""Result tables of micro-batches: one Parquet folder per batch number.

A folder counts once Spark's committer has written its ``_SUCCESS`` marker, and a replayed
batch overwrites its own folder, so every write is idempotent. Readers of batch ``b`` use
folders below ``b`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StructField, StructType


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path and the path in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


class BatchTable:
    def __init__(
        self, spark: SparkSession, root: str, schema: StructType, partition: str | None = None
    ):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.partition = partition
        self._numbered = StructType([*schema.fields, StructField("batch", LongType())])

    def _path(self, batch: int) -> str:
        return f"{self.root}/batch={batch}"

    def put(self, batch: int, rows: DataFrame) -> None:
        """Write the folder of a batch; the rows must not read the same folder."""
        writer = rows.select(*self.schema.fieldNames()).write.mode("overwrite")
        if self.partition:
            writer = writer.partitionBy(self.partition)
        writer.parquet(self._path(batch))

    def committed(self, below: int | None = None) -> list[int]:
        """Finished batches, by one listing of their markers."""
        fs, markers = hadoop_path(self.spark, f"{self.root}/batch=*/_SUCCESS")
        names = [s.getPath().getParent().getName() for s in fs.globStatus(markers) or []]
        batches = sorted(int(n.removeprefix("batch=")) for n in names)
        return [b for b in batches if below is None or b < below]

    def read(self, batches: list[int]) -> DataFrame:
        """Rows of the given batches, with their batch number as ``batch``."""
        if not batches:
            return self.spark.createDataFrame([], self._numbered)
        return (
            self.spark.read.schema(self._numbered)
            .option("basePath", self.root)
            .parquet(*[self._path(b) for b in batches])
        )

    def drop(self, batches: list[int]) -> None:
        """Remove folders that later ones replace."""
        for batch in batches:
            fs, path = hadoop_path(self.spark, self._path(batch))
            fs.delete(path, True)


class KeyedTable:
    """The last version of each row, kept up by batches, in levels of merged runs.

    A batch adds one run with the rows it changes, at level 0. Once ``fanout`` times as many
    batches as a run of a level spans are over, the runs within are merged into one of the next
    level; the later version of a row wins. So a row is written once for each level, not each time
    the table is merged, and there are few runs to read. Rows lie in buckets by the hash of
    ``spread``: a run has the buckets its rows touch, and a batch reads only those it needs.

    With ``day``, an SQL expression, rows that a batch calls settled leave the runs when they are
    merged, into folders by day, which are not written again and read from a day on.

    A merge takes runs of earlier batches only, so a batch that is replayed finds what it found
    before. Merged runs are removed some batches later, for readers that have just opened them.
    """

    BUCKET = "bucket"
    DAY = "day"
    #: Settled rows leave from this level on, so that days do not get a file for each batch.
    SETTLE_LEVEL = 2

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: StructType,
        keys: list[str],
        spread: str,
        buckets: int = 64,
        fanout: int = 4,
        day: str | None = None,
    ):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.keys, self.spread, self.day = keys, spread, day
        self._held = StructType([*schema.fields, StructField(self.BUCKET, IntegerType())])
        self._settled_schema = StructType(
            [*self._held.fields, StructField("batch", LongType()), StructField(self.DAY, DateType())]
        )
        self._wanted, self._layout = (buckets, fanout), None

    # -- layout ------------------------------------------------------------------------

    def _exists(self, path: str) -> bool:
        fs, path = hadoop_path(self.spark, path)
        return fs.exists(path)

    def layout(self) -> tuple[int, int]:
        """Buckets and fanout: as stored with the table, or as wanted where there is none yet."""
        if self._layout is None:
            path = f"{self.root}/layout"
            if not self._exists(f"{path}/_SUCCESS"):
                return self._wanted
            row = self.spark.read.parquet(path).first()
            self._layout = (row["buckets"], row["fanout"])
        return self._layout

    def _keep_layout(self) -> None:
        self.layout()
        if self._layout is None:
            row = self.spark.createDataFrame([self._wanted], "buckets int, fanout int")
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/layout")

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.layout()[0])).cast("int")

    def needed(self, rows: DataFrame) -> list[int]:
        """The buckets that the rows' keys lie in: at most as many numbers as there are buckets."""
        found = rows.select(self._bucket(self.spread).alias("b")).distinct().collect()
        return sorted(r["b"] for r in found)

    # -- runs --------------------------------------------------------------------------

    def _level(self, level: int) -> BatchTable:
        return BatchTable(self.spark, f"{self.root}/level={level}", self._held, self.BUCKET)

    def runs(self, below: int | None = None) -> list[tuple[int, int]]:
        """Finished runs as (level, last batch), by one listing of their markers."""
        fs, markers = hadoop_path(self.spark, f"{self.root}/level=*/batch=*/_SUCCESS")
        found = []
        for status in fs.globStatus(markers) or []:
            run = status.getPath().getParent()
            level = int(run.getParent().getName().removeprefix("level="))
            found.append((level, int(run.getName().removeprefix("batch="))))
        return sorted(r for r in found if below is None or r[1] < below)

    def _covers(self, run: tuple[int, int], other: tuple[int, int]) -> bool:
        """Does a merged run hold all batches of another?"""
        span = self.layout()[1] ** run[0]
        return run[0] > other[0] and run[1] - span < other[1] <= run[1]

    def live(self, below: int | None = None) -> list[tuple[int, int]]:
        """The runs that together hold the table."""
        runs = self.runs(below)
        return [r for r in runs if not any(self._covers(o, r) for o in runs)]

    # -- reading and writing -------------------------------------------------------------

    def _read_runs(self, runs: list[tuple[int, int]]) -> DataFrame:
        levels = sorted({level for level, _ in runs}) or [0]
        parts = [self._level(n).read([b for level, b in runs if level == n]) for n in levels]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows

    def _read_settled(self, since: str | None) -> DataFrame | None:
        path = f"{self.root}/settled"
        if self.day is None or not self._exists(path):
            return None
        rows = self.spark.read.schema(self._settled_schema).parquet(path)
        # A filter on the folders of days.
        return rows if since is None else rows.where(F.col(self.DAY) >= F.lit(since).cast("date"))

    def _latest(self, rows: DataFrame, *more: str) -> DataFrame:
        values = F.struct(*[c for c in self.schema.fieldNames() if c not in self.keys], *more)
        return (
            rows.groupBy(*self.keys)
            .agg(F.max_by(values, "batch").alias("_v"))
            .select(*self.keys, "_v.*")
            .select(*self.schema.fieldNames(), *more)
        )

    def read(
        self,
        below: int | None = None,
        buckets: list[int] | None = None,
        since: str | None = None,
        mark: str | None = None,
    ) -> DataFrame:
        """What the batches (below a number) left behind, in all or some buckets; of settled rows
        those from the day ``since`` on. ``mark`` adds a column that is true for settled ones."""
        mark_name = mark or "_mark"
        rows = self._read_runs(self.live(below)).withColumn(mark_name, F.lit(False))
        settled = self._read_settled(since)
        if settled is not None:
            settled = settled.withColumn(mark_name, F.lit(True)).select(*rows.columns)
            rows = rows.unionByName(settled if below is None else settled.where(F.col("batch") < below))
        if buckets is not None:
            # A filter on the folders of runs: other buckets are not read.
            rows = rows.where(F.col(self.BUCKET).isin(buckets))
        return self._latest(rows, *([mark] if mark else []))

    def put(self, batch: int, rows: DataFrame, settled: Column | None = None) -> None:
        """Add the rows that a batch changes; they must not repeat a key. ``settled`` tells which
        stored rows may go to the folders by day."""
        self._keep_layout()
        self._level(0).put(batch, rows.withColumn(self.BUCKET, self._bucket(self.spread)))
        self._drop_merged(batch)
        self._merge(batch, settled)

    def _drop_merged(self, batch: int) -> None:
        """Remove runs whose merged run is some batches old."""
        runs, fanout = self.runs(), self.layout()[1]
        for level, last in runs:
            if any(self._covers(o, (level, last)) and o[1] < batch - fanout for o in runs):
                self._level(level).drop([last])

    def _merge(self, batch: int, settled: Column | None) -> None:
        fanout, level = self.layout()[1], 1
        while fanout**level <= batch:
            span = fanout**level
            members: dict[int, list[tuple[int, int]]] = {}
            for run in self.live(batch):
                end = (run[1] // span + 1) * span - 1
                if run[0] < level and end < batch:
                    members.setdefault(end, []).append(run)
            for end, runs in sorted(members.items()):
                if len(runs) > 1:
                    self._merge_runs(level, end, runs, settled)
            level += 1

    def _merge_runs(self, level, end, runs, settled: Column | None) -> None:
        merged = self._latest(self._read_runs(runs)).withColumn(
            self.BUCKET, self._bucket(self.spread)
        )
        if self.day is not None and settled is not None and level >= self.SETTLE_LEVEL:
            done = F.coalesce(settled, F.lit(False))
            # Written before the run without them; should it be written twice, both are the same.
            (
                merged.where(done)
                .withColumn("batch", F.lit(end).cast("bigint"))
                .withColumn(self.DAY, F.expr(self.day))
                .select(*self._settled_schema.fieldNames())
                .repartition(self.DAY)
                .write.mode("append")
                .partitionBy(self.DAY)
                .parquet(f"{self.root}/settled")
            )
            merged = merged.where(~done)
        self._level(level).put(end, merged)
