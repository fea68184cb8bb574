"""Stored tables that lie by device, so that joining them moves no rows.

A table has as many buckets as the others of its set, by hash of its key, sorted by it, and the
catalogue knows it: Catalyst plans joins by the key and aggregates by it bucket against bucket,
without an exchange.

A bucket is one task, so a device with a third of all rows must not lie in one. Hot keys (at most
``SplitPolicy.max_ranges``) are found when a table is written; their rows go to a second table, in
ranges of key and order. ``joined`` brings what the other tables say of these few keys to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.operators.sizing import SplitPolicy, hot_keys, settled


@dataclass(frozen=True)
class BucketedTables:
    """Tables below ``path``, in the catalogue as ``prefix`` and their name.

    ``buckets`` holds for all of them; a bucket should fit in a task: choose it for the largest
    table, as it cannot change without writing all of them anew."""

    spark: SparkSession
    path: str
    prefix: str
    buckets: int = 256
    key: str = "device"

    def _cold(self, name: str) -> str:
        return f"{self.prefix}_{name}"

    def _hot(self, name: str) -> str:
        return f"{self.prefix}_{name}_hot"

    def _hot_keys(self, rows: DataFrame, policy: SplitPolicy) -> DataFrame | None:
        if not policy.applies_to(rows, [self.key]):
            return None
        hot = settled(hot_keys(rows.select(self.key), [self.key], policy).select(self.key))
        return None if hot.isEmpty() else hot

    def write(
        self, name: str, rows: DataFrame, order: list[str], policy: SplitPolicy | None = None
    ) -> None:
        """Replace a table. ``order`` tells the rows of a key apart. Rows without a key join
        nothing; they lie in a bucket like those of any key, the hot ones too if they are many."""
        policy = policy or SplitPolicy()
        self.spark.sql(f"DROP TABLE IF EXISTS {self._hot(name)}")
        hot = self._hot_keys(rows, policy)
        if hot is not None:
            same = F.col(f"r.{self.key}").eqNullSafe(F.col(f"h.{self.key}"))
            few = F.broadcast(hot).alias("h")
            by = [self.key, *order]
            crowded = rows.alias("r").join(few, same, "left_semi").repartitionByRange(*by)
            writer = crowded.sortWithinPartitions(*by).write.mode("overwrite")
            writer.option("path", f"{self.path}/{name}_hot").saveAsTable(self._hot(name))
            rows = rows.alias("r").join(few, same, "left_anti")
        (
            # Dealt out as the buckets are, each is one file.
            rows.repartition(self.buckets, self.key)
            .write.mode("overwrite")
            .bucketBy(self.buckets, self.key)
            .sortBy(self.key)
            .option("path", f"{self.path}/{name}")
            .saveAsTable(self._cold(name))
        )

    def read(self, name: str) -> DataFrame:
        """All rows of a table."""
        cold = self.spark.table(self._cold(name))
        if not self.spark.catalog.tableExists(self._hot(name)):
            return cold
        return cold.unionByName(self.spark.table(self._hot(name)))

    def joined(self, name: str, *others: str, how: str = "inner") -> DataFrame:
        """The rows of a table with those of ``others`` that have their key, in the columns of all.

        ``how`` is "inner" or "left". The others hold a key at most once; one that had hot keys
        when it was written is refused. Names of columns other than the key must differ."""
        if how not in ("inner", "left"):
            raise ValueError("a join by buckets is inner or left")
        for other in others:
            if self.spark.catalog.tableExists(self._hot(other)):
                raise ValueError(f"{other} has keys with many rows; join to it, not with it")
        # Said by hint, as a small side would be sent to all tasks; no side is too large for this.
        found = self.spark.table(self._cold(name))
        for other in others:
            found = found.join(self.spark.table(self._cold(other)).hint("merge"), self.key, how)
        if not self.spark.catalog.tableExists(self._hot(name)):
            return found
        crowded = self.spark.table(self._hot(name))
        # As many rows as there are hot keys at most.
        keys = crowded.select(self.key).distinct()
        for other in others:
            about = self.spark.table(self._cold(other)).join(F.broadcast(keys), self.key, "left_semi")
            crowded = crowded.join(F.broadcast(about), self.key, how)
        return found.unionByName(crowded)

    def check_unique(self, name: str) -> None:
        """Raise where a key (other than NULL) has more than one row."""
        rows = self.spark.table(self._cold(name)).where(F.col(self.key).isNotNull())
        twice = rows.groupBy(self.key).count().where("count > 1")
        if not twice.isEmpty() or self.spark.catalog.tableExists(self._hot(name)):
            raise ValueError(f"{name} has keys with more than one row")
