"""Tables of documents, intermediate results in the shared folder, bounded row filters."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail import session

# White space as the contracts of this package count it: blank, tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# Spark removes the shuffle files of a query as soon as it has ended.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Rows go to Python workers in batches of at most so many bytes, or one longer row: a batch is held
# by the executor and by the worker, coming and going.
BATCH_BYTES = 8 << 20
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lets the session send batches of ``BATCH_BYTES`` to Python workers, or smaller ones where it
    does so already. No result depends on it."""
    size, unit = re.fullmatch(r"(\d+)([bkmgtp]?)b?", spark.conf.get(BATCHES).lower()).groups()
    if int(size) << 10 * "bkmgtp".index(unit or "b") > BATCH_BYTES:
        spark.conf.set(BATCHES, str(BATCH_BYTES))


def documents(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder and read back from there. The shuffle
    files of the write go with its end: nothing else uses them."""
    spark = df.sparkSession
    path = f"{session.run_folder(spark)}/table"
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def give_back_memory() -> None:
    """Lets the system have what was freed; an allocator may keep it for long."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def giving_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``, giving memory back when a task has ended: its Python worker
    stays for tasks of other stages."""

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back_memory()

    return task


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: fixes which rows are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def bucket_flag(
    df: DataFrame, wanted: DataFrame, keys: list[str], name: str, bits: int = 20
) -> DataFrame:
    """``df`` with a column ``name`` that is true where the keys may be in ``wanted``: for all
    that are, and for some others.

    Only the distinct numbers of hash buckets are broadcast, at most ``2 ** bits`` integers
    whatever the size of ``wanted``. With so many keys that the buckets fill up, every row is
    flagged; a wanted one always is."""

    def bucket() -> Column:
        return F.pmod(F.xxhash64(*(F.col(k) for k in keys)), F.lit(1 << bits)).cast("int")

    buckets = wanted.select(bucket().alias("_bucket")).distinct().withColumn("_in", F.lit(True))
    flagged = df.withColumn("_bucket", bucket()).join(F.broadcast(buckets), "_bucket", "left")
    return flagged.withColumn(name, F.col("_in").isNotNull()).drop("_bucket", "_in")


def whole(docs: DataFrame) -> Column:
    """All columns of a row in one, out of the way of an operator's own names."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
