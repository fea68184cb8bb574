"""Size checks: when to split hot keys and what may be broadcast."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.session import shared_folder


#: Tasks up to which each range has one of its own; more short ones cost more than their rows.
TASKS = 256


@dataclass(frozen=True)
class Cut:
    """A table in so many ``ranges`` and ``tasks``. With fewer tasks than ranges each has several,
    of ``rows`` rows, one after the other."""

    ranges: int
    tasks: int
    rows: int = 0


@dataclass(frozen=True)
class SplitPolicy:
    """When keys are too large for a task, and how many ranges their rows are dealt out to.

    A key is hot when it has more rows than ``target_rows`` or than 1/``max_ranges`` of the
    table, whichever is larger. A table with a hot key is cut into ranges of about as many rows,
    at most ``max_ranges``, which bounds what is sent to every task: two rows for each range.

    ``mode``: "on", "off", or "auto", which splits only when the input is too large for a
    single task by its estimated size and a count of its keys then finds a hot one. That
    count reads the key columns alone; without hot keys the plan stays the plain one.
    """

    target_rows: int = 4_000_000
    max_ranges: int = 16_384
    small_input_bytes: int = 256 << 20
    mode: str = "auto"

    def forced(self, target_rows: int | None = None) -> SplitPolicy:
        return replace(self, mode="on", target_rows=target_rows or self.target_rows)

    def off(self) -> SplitPolicy:
        return replace(self, mode="off")

    def looks_into(self, df: DataFrame) -> bool:
        """Will ``applies_to`` or a split read the rows?"""
        if self.mode == "auto":
            return estimated_bytes(df) > self.small_input_bytes
        return self.mode == "on"

    def applies_to(self, df: DataFrame, keys: list[str]) -> bool:
        if self.mode != "auto" or not self.looks_into(df):
            return self.mode == "on"
        return not hot_keys(df.select(*keys), keys, self).isEmpty()

    def for_batch(self, df: DataFrame, keys: list[str], rows: int) -> SplitPolicy:
        """The policy for a kept batch of so many ``rows``: a large one is cut into ranges only
        where a key is hot, else windows by key have more tasks than there would be ranges."""
        if self.mode == "on":
            return self
        hot = rows > self.target_rows and not hot_keys(df.select(*keys), keys, self).isEmpty()
        return self.forced() if hot else self.off()

    def cut(self, df: DataFrame) -> Cut:
        """How the rows of ``df`` are cut into ranges. Tasks have several only beyond ``TASKS``,
        and then no more rows than one range has by default."""
        rows = df.count()
        ranges = max(1, min(-(-rows // self.target_rows), self.max_ranges))
        tasks = min(ranges, max(TASKS, -(-rows // SplitPolicy.target_rows)))
        return Cut(ranges, tasks, -(-rows // ranges))


def estimated_bytes(df: DataFrame) -> int:
    """Size of the inputs a plan reads: file sizes for file scans, huge when nothing is known.

    Taken at the leaves, as Catalyst's estimate above a join multiplies the two sides.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def settled(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def hot_keys(df: DataFrame, keys: list[str], policy: SplitPolicy, *extra) -> DataFrame:
    """Keys with more rows than one task should hold: ``keys, rows, row_limit`` and ``extra``
    aggregates. Counts are combined map-side; at most ``max_ranges`` rows come out."""
    total = df.agg(F.count(F.lit(1)).alias("rows")).scalar()
    limit = F.greatest(
        F.lit(policy.target_rows).cast("bigint"),
        F.ceil(total / F.lit(policy.max_ranges)).cast("bigint"),
    )
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *extra)
    return counted.withColumn("row_limit", limit).where(F.col("rows") > F.col("row_limit"))
