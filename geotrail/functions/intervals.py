"""Time window arguments of the read queries, turned into filter columns.

Two notations exist. The history queries take ``partial-time[;shift[;period;count]]``:
a cut-off timestamp stands for its whole unit, the shift moves the upper bound, and
period and count repeat the window. The visit query takes ``from[;to]`` in whole seconds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL = "all"
TICK = timedelta(microseconds=1)

# Accepted spellings of a time, from coarse to fine, with the unit each stands for.
PARTIAL_FORMATS = (
    ("%Y", "y"),
    ("%Y-%m", "M"),
    ("%Y-%m-%d", "d"),
    ("%Y-%m-%dT%H", "h"),
    ("%Y-%m-%dT%H:%M", "m"),
    ("%Y-%m-%dT%H:%M:%S", "s"),
)
STEP = {
    "u": timedelta(microseconds=1),
    "T": timedelta(milliseconds=1),
    "s": timedelta(seconds=1),
    "m": timedelta(minutes=1),
    "h": timedelta(hours=1),
    "d": timedelta(days=1),
    "w": timedelta(weeks=1),
}


@dataclass(frozen=True)
class Span:
    """Closed time range; ``hi`` None means open-ended."""

    lo: datetime
    hi: datetime | None


def _shift(at: datetime, amount: int, unit: str) -> datetime:
    if unit in STEP:
        return at + amount * STEP[unit]
    months = amount * (12 if unit == "y" else 1)
    index = at.year * 12 + at.month - 1 + months
    year, month = divmod(index, 12)
    for day in range(at.day, 27, -1):
        try:
            return at.replace(year=year, month=month + 1, day=day)
        except ValueError:
            continue
    return at.replace(year=year, month=month + 1)


def _amount(text: str, signed: bool) -> tuple[int, str]:
    sign = "[-+]?" if signed else ""
    found = re.fullmatch(rf"({sign}\d+)([uTsmhdwMy])", text)
    if found is None:
        raise ValueError(f"not a time amount: {text!r}")
    return int(found.group(1)), found.group(2)


def _unit(text: str) -> tuple[datetime, datetime]:
    """First and last microsecond of the unit a partial time stands for."""
    text = text.removesuffix("Z")
    for pattern, unit in PARTIAL_FORMATS:
        try:
            lo = datetime.strptime(text, pattern)
        except ValueError:
            continue
        return lo, _shift(lo, 1, unit) - TICK
    found = re.fullmatch(r"(.+)\.(\d{1,6})", text)
    if found is None:
        raise ValueError(f"not a time: {text!r}")
    digits = found.group(2)
    lo = datetime.strptime(found.group(1), "%Y-%m-%dT%H:%M:%S")
    lo += timedelta(microseconds=int(digits.ljust(6, "0")))
    return lo, lo + timedelta(microseconds=10 ** (6 - len(digits))) - TICK


def history_spans(text: str) -> list[Span]:
    """Windows of a history argument, e.g. ``2024-02-07T17:26;1m``."""
    parts = [p.strip() for p in text.split(";")]
    if len(parts) not in (1, 2, 4):
        raise ValueError(f"not a time window: {text!r}")
    lo, hi = _unit(parts[0])
    if len(parts) > 1:
        # Month and year shifts move the exclusive end, so that a month's end
        # lands on a month's end.
        hi = _shift(hi + TICK, *_amount(parts[1], signed=True)) - TICK
    if len(parts) < 4:
        return [Span(lo, hi)]
    step, unit = _amount(parts[2], signed=False)
    return [
        Span(_shift(lo, step * i, unit), _shift(hi + TICK, step * i, unit) - TICK)
        for i in range(int(parts[3]))
    ]


def visit_span(text: str) -> Span:
    """Window of the visit query, ``2024-01-05T00:00:00;2024-01-06T00:00:00``."""
    first, _, rest = text.partition(";")
    last = rest.split(";")[0]
    pattern = "%Y-%m-%dT%H:%M:%S"
    return Span(
        datetime.strptime(first, pattern), datetime.strptime(last, pattern) if last else None
    )


def _literal(at: datetime, ntz: bool) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz" if ntz else "timestamp")


def within(ts: Column, spans: list[Span], ntz: bool = False, date: Column | None = None) -> Column:
    """Filter on ``ts``; ``date`` is the partition column, when there is one."""
    condition = None
    for span in spans:
        one = ts >= _literal(span.lo, ntz)
        if span.hi is not None:
            one = one & (ts <= _literal(span.hi, ntz))
        if date is not None:
            one = one & (date >= F.lit(span.lo.date()))
            if span.hi is not None:
                one = one & (date <= F.lit(span.hi.date()))
        condition = one if condition is None else condition | one
    return F.lit(False) if condition is None else condition
