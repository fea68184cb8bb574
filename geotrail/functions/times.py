"""Epoch conversions. All assume a UTC session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros_to_millis(micros: Column) -> Column:
    """Whole milliseconds, fraction cut off towards zero."""
    return F.call_function("div", micros, F.lit(1000))


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def from_micros(micros: Column) -> Column:
    return F.timestamp_micros(micros)


def from_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def cut_to_millis(ts: Column) -> Column:
    """The tracker's clock: millisecond timestamps."""
    return from_millis(micros_to_millis(epoch_micros(ts)))
