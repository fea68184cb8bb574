"""Topic sources and sinks. The connector jar comes with the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCATIONS_TOPIC = "new_locations"
COLLISIONS_TOPIC = "collisions"


def secured(protocol: str = "SASL_SSL", mechanism: str = "PLAIN", login: str = "") -> dict:
    """Options for a broker that asks for a login; ``login`` is the JAAS line."""
    return {
        "kafka.security.protocol": protocol,
        "kafka.sasl.mechanism": mechanism,
        "kafka.sasl.jaas.config": login,
    }


def source_options(
    servers: str, topic: str, committed_only: bool = False, max_offsets: int = 50_000_000,
    extra: dict | None = None, skip_lost: bool = False,
) -> dict:
    """Start at the earliest offset; later runs go on from the query's checkpoint. The limit
    per trigger bounds a micro-batch, also when a long backlog is read. Offsets that the topic
    has lost stop the query, unless the caller says to ``skip_lost`` ones."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": str(max_offsets),
        "failOnDataLoss": str(not skip_lost).lower(),
    }
    if committed_only:
        options["kafka.isolation.level"] = "read_committed"
    return {**options, **(extra or {})}


def sink_options(servers: str, topic: str, extra: dict | None = None) -> dict:
    options = {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.acks": "all",
        "kafka.enable.idempotence": "true",
    }
    return {**options, **(extra or {})}


def text_columns(records: DataFrame) -> DataFrame:
    """Binary topic records to the text form the parsers read."""
    return records.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "partition",
        "offset",
    )


def stream_topic(spark: SparkSession, options: dict) -> DataFrame:
    return text_columns(spark.readStream.format("kafka").options(**options).load())


def stream_to_topic(records: DataFrame, options: dict, checkpoint: str, every: str = "5 seconds"):
    """Start publishing ``key, value`` records, at least once."""
    return (
        records.select("key", "value")
        .writeStream.format("kafka")
        .options(**options)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )
