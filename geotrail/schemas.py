"""Schemas of the messages and tables the jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

# Incoming message. ``id`` and ``timestamp`` are read as text first, so that a
# quoted number is accepted like a bare one.
LOCATION_MESSAGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField(
            "point",
            T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType())]),
        ),
        T.StructField("timestamp", T.StringType()),
    ]
)

# One record of the location topic, whatever the transport.
TOPIC_RECORD = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)

# Stored history: the nested point is flat and the time keeps microseconds.
HISTORY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("point_x", T.DoubleType()),
        T.StructField("point_y", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
    ]
)

# Published enter/exit message; dates are quoted epoch milliseconds.
COLLISION_MESSAGE = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("polygon", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("in", T.BooleanType()),
        T.StructField("collision_point_in", POINT),
        T.StructField("collision_date_in", T.StringType()),
        T.StructField("collision_point_out", POINT),
        T.StructField("collision_date_out", T.StringType()),
    ]
)

FENCE_ROW = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("wkt", T.StringType()),
        T.StructField("creation", T.TimestampType()),
        T.StructField("valid", T.BooleanType()),
        T.StructField("category", T.LongType()),
    ]
)

CATEGORY_ROW = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]
)

USER_ROW = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("device", T.LongType())]
)
