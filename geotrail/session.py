"""Session settings the jobs rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that must hold for right results or for the plans in this package.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # State of streams on disk, not on the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}
# Beyond this, map outputs become many tiny blocks; larger partitions spill instead.
MAX_SHUFFLE_PARTITIONS = 65_536
# The shared folder of a session that is one process and names none, by application.
_LOCAL_FOLDERS: dict[str, str] = {}
# Call-site capture on every column function costs more time than planning does.
AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(master: str | None = None, app: str = "geotrail", **conf: str) -> SparkSession:
    """A session with the required settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **AT_START}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def pin(spark: SparkSession) -> SparkSession:
    """Apply the required settings to a session somebody else started."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Without that setting a session that is one process, as in tests, gets one local folder; on
    a cluster, where executors would each write to a disk of their own, this raises."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="shared-")
    return _LOCAL_FOLDERS[application]


def run_folder(spark: SparkSession) -> str:
    """A new folder for the tables of one run, below the shared one."""
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def size_shuffles(spark: SparkSession, input_bytes: int, partition_bytes: int = 128 << 20) -> int:
    """Let shuffles start with enough partitions for an input of this size; adaptive execution
    merges those that turn out small. Never below the session's own setting."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(least, min(input_bytes // partition_bytes, MAX_SHUFFLE_PARTITIONS))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return wanted
