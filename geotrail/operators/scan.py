"""Running values per key, whatever the size of a key: a prefix scan over ranges of the order.

A window over one key runs in one task. Here the rows are dealt out by range of (key, order), so a
key of any size lies in as many ranges as it needs, rows of one position included as long as the
order tells them apart. Each range is summarised for its first and its last key, the only ones it
can share with other ranges: at most two rows for each range. A scan over these rows gives each
range what came before it, and one pass applies that to the rows. The rows are exchanged once.

A task has one range, or several short ones, which it goes through one after the other.

The ranges are written to the checkpoint folder before they are used: the bounds come from a
sample, and every step must see the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotrail.operators.sizing import Cut, settled

RANGE = "_range"
PLACE = "_place"  # 2: first row of its range, 1: another row of the range's first key, 0: rest
HELPERS = (RANGE, PLACE)


@dataclass(frozen=True)
class Measures:
    """What runs along a key, by the name of the new column:

    ``sums``: the sum of a whole-number column up to and with the row; ``lows``: the lowest value
    so far of such a sum, at most 0; ``lags``: a column's value in the row before."""

    sums: dict[str, str] = field(default_factory=dict)
    lows: dict[str, str] = field(default_factory=dict)
    lags: dict[str, str] = field(default_factory=dict)

    def counted(self) -> list[str]:
        """The columns that are added up."""
        return sorted({*self.sums.values(), *self.lows.values()})


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.fill_null(_column(batch, name), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _opens(batch: pa.RecordBatch, before: pa.RecordBatch | None, keys: list[str]) -> np.ndarray:
    """Which rows start a key; ``before`` is the row before the batch. Nulls are one key."""
    opens = np.zeros(batch.num_rows, dtype=bool)
    for name in keys:
        own = _column(batch, name)
        first = pa.nulls(1, own.type) if before is None else _column(before, name)
        shifted = pa.concat_arrays([first, own.slice(0, len(own) - 1)])
        differs = pc.fill_null(pc.not_equal(own, shifted), False)
        nulls = pc.not_equal(pc.is_null(own), pc.is_null(shifted))
        opens |= pc.or_(differs, nulls).to_numpy(zero_copy_only=False)
    if before is None:
        opens[0] = True
    return opens


def _running_sum(values: np.ndarray, segment: np.ndarray, opens: np.ndarray, carried: int):
    """Sums along each segment; ``carried`` goes to the one that is open already."""
    total = np.cumsum(values)
    base = np.append(-carried, (total - values)[opens])
    return total - base[segment]


def _running_low(sums: np.ndarray, segment: np.ndarray, carried: int) -> np.ndarray:
    """The lowest so far along each segment, at most 0."""
    # Each segment is lowered below all earlier ones, so that their minimum ends with them.
    step = int(sums.max(initial=0) - sums.min(initial=0)) + 1
    lowest = np.minimum.accumulate(sums - segment * step) + segment * step
    return np.minimum(lowest, np.where(segment == 0, min(carried, 0), 0))


class _Carry:
    """The running values of the key that a task is at."""

    def __init__(self, measures: Measures):
        self.row: pa.RecordBatch | None = None
        self.sums = dict.fromkeys(measures.counted(), 0)
        self.lows = dict.fromkeys(measures.lows, 0)

    def along(self, batch: pa.RecordBatch, keys: list[str], measures: Measures):
        """Sums by column, lows by name and the starts of keys in the next rows; moves on."""
        opens = _opens(batch, self.row, keys)
        segment = np.cumsum(opens)
        sums = {
            c: _running_sum(_numbers(batch, c), segment, opens, self.sums[c]) for c in self.sums
        }
        lows = {
            n: _running_low(sums[c], segment, self.lows[n]) for n, c in measures.lows.items()
        }
        before, self.row = self.row, batch.slice(batch.num_rows - 1)
        self.sums = {c: int(v[-1]) for c, v in sums.items()}
        self.lows = {n: int(v[-1]) for n, v in lows.items()}
        return opens, sums, lows, before


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each range in a batch, with its number."""
    for batch in batches:
        if not batch.num_rows:
            continue
        number = _column(batch, RANGE).to_numpy()
        ends = [*(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), batch.num_rows]
        for start, end in zip([0, *ends], ends):
            yield int(number[start]), batch.slice(start, end - start)


def _each_range(run: Callable) -> Callable:
    """``run`` for one range of a task after the other."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in groupby(_pieces(batches), key=lambda piece: piece[0]):
            yield from run(batch for _, batch in pieces)

    return runs


def _local(keys: list[str], measures: Measures) -> Callable:
    """Function for ``mapInArrow``: rows with the running values within their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, first_key, first_row = _Carry(measures), True, True
        for batch in batches:
            if not batch.num_rows:
                continue
            opens, sums, lows, before = carry.along(batch, keys, measures)
            place = np.zeros(batch.num_rows, dtype=np.int8)
            if first_key:
                later = np.flatnonzero(opens[1:] if first_row else opens) + first_row
                upto = later[0] if len(later) else batch.num_rows
                place[:upto] = 1
                place[0] += first_row
                first_key, first_row = not len(later), False
            columns, names = list(batch.columns), list(batch.schema.names)
            columns += [pa.array(sums[c]) for c in measures.sums.values()]
            columns += [pa.array(lows[n]) for n in measures.lows]
            for source in measures.lags.values():
                own = _column(batch, source)
                first = pa.nulls(1, own.type) if before is None else _column(before, source)
                shifted = pa.concat_arrays([first, own.slice(0, len(own) - 1)])
                columns.append(pc.if_else(pa.array(opens), pa.scalar(None, own.type), shifted))
            columns.append(pa.array(place))
            names += [*measures.sums, *measures.lows, *measures.lags, PLACE]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _edges(keys: list[str], measures: Measures) -> Callable:
    """Function for ``mapInArrow``: the last row of a range's first and of its last key, with the
    sums and lows of that key in the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, first = _Carry(measures), None

        def edge(row: pa.RecordBatch, sums: dict, lows: dict) -> pa.RecordBatch:
            values = [pa.array([v], pa.int64()) for v in (*sums.values(), *lows.values())]
            names = [*(f"_sum_{c}" for c in sums), *(f"_low_{n}" for n in lows)]
            return pa.RecordBatch.from_arrays([*row.columns, *values], [*row.schema.names, *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = edge(carry.row, carry.sums, carry.lows) if carry.row is not None else None
            opens, sums, lows, _ = carry.along(batch, keys, measures)
            starts = np.flatnonzero(opens)
            if first is None and held is not None and len(starts):
                at = starts[0] - 1
            elif first is None and len(starts) > 1:
                at = starts[1] - 1
            else:
                continue
            # The row before the second key is the last one of the first key.
            first = held if at < 0 else edge(
                batch.slice(at, 1),
                {c: int(v[at]) for c, v in sums.items()},
                {n: int(v[at]) for n, v in lows.items()},
            )
        if first is not None:
            yield first
        if carry.row is not None:
            yield edge(carry.row, carry.sums, carry.lows)

    return run


def ranged(df: DataFrame, keys: list[str], order: list[str], ranges: int | Cut) -> DataFrame:
    """``df`` in at most ``ranges`` ranges of (keys, order), sorted, with their number RANGE,
    which rises along the order. A ``Cut`` says how many tasks have them."""
    cut = ranges if isinstance(ranges, Cut) else Cut(ranges, ranges)
    by = [F.col(c) for c in (*keys, *order)]
    dealt = df.repartitionByRange(max(cut.tasks, 1), *by).sortWithinPartitions(*by)
    number = F.spark_partition_id()
    if cut.tasks < cut.ranges:
        # This id is the number of the task in the bits from 33 on and the row's place below.
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        within = F.call_function("div", place, F.lit(cut.rows).cast("bigint"))
        number = F.shiftleft(number.cast("bigint"), 33) + within
    return settled(dealt).withColumn(RANGE, number)


def scanned(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: Measures,
    ranges: int | Cut,
    then: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``df`` with the columns of ``measures``, along ``order`` within each value of ``keys``.

    ``then`` adds columns row by row after the rows are dealt out, for ``lags`` to use; it must
    leave rows where they are."""
    rows = ranged(df, keys, order, ranges)
    added = then or (lambda same: same)
    full = added(rows)
    kinds = {f.name: f.dataType for f in full.schema}
    whole = [T.StructField(n, T.LongType()) for n in (*measures.sums, *measures.lows)]
    lagged = [T.StructField(n, kinds[c]) for n, c in measures.lags.items()]
    place = T.StructField(PLACE, T.ByteType())
    local = full.mapInArrow(
        _each_range(_local(keys, measures)), T.StructType([*full.schema.fields, *whole, *lagged, place])
    )
    carried = _carried(rows, keys, measures, added)
    heads = (local[RANGE] == carried["_into"]) & (local[PLACE] > 0)
    # One row for each range at most.
    joined = local.join(F.broadcast(carried), heads, "left")
    zero = F.lit(0).cast("bigint")
    filled = {}
    for name, column in measures.sums.items():
        filled[name] = F.col(name) + F.coalesce(f"_base_{column}", zero)
    for name, column in measures.lows.items():
        later = F.col(name) + F.coalesce(f"_base_{column}", zero)
        filled[name] = F.least(later, F.coalesce(f"_before_{name}", zero))
    for name in measures.lags:
        filled[name] = F.when(F.col(PLACE) == 2, F.col(f"_lag_{name}")).otherwise(F.col(name))
    return joined.select(
        *[F.col(f"`{c}`") for c in full.columns if c not in HELPERS],
        *[value.alias(name) for name, value in filled.items()],
    )


def _carried(
    rows: DataFrame, keys: list[str], measures: Measures, added: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """What each range takes over for its first key, by its number ``_into``."""
    counted = measures.counted()
    ends = [f"_sum_{c}" for c in counted] + [f"_low_{n}" for n in measures.lows]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in ends)])
    edges = added(rows.mapInArrow(_each_range(_edges(keys, measures)), schema))
    in_order = Window.partitionBy(*keys).orderBy(RANGE)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    base = edges.select(
        *keys,
        RANGE,
        *ends,
        F.row_number().over(in_order).alias("_nth"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), zero).alias(f"_base_{c}") for c in counted],
        *[F.lag(c).over(in_order).alias(f"_lag_{n}") for n, c in measures.lags.items()],
    )
    lowest = [
        F.least(
            zero,
            F.coalesce(F.min(F.col(f"_base_{c}") + F.col(f"_low_{n}")).over(earlier), zero),
        ).alias(f"_before_{n}")
        for n, c in measures.lows.items()
    ]
    names = [f"_base_{c}" for c in counted] + [f"_lag_{n}" for n in measures.lags]
    # A key goes on into a range only as that range's first key.
    return base.select(F.col(RANGE).alias("_into"), "_nth", *names, *lowest).where("_nth > 1")
