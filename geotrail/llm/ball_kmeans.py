"""Vector code compression: product codes whose codebooks ball k-means learns, in whole numbers.

Components become ``floor(scale * x)``, vectors are cut into equal consecutive parts and each part
position has a codebook of its own. A round assigns every part to its nearest entry (squared
distance, ties to the lower index) and moves each entry to the floored mean of its parts.

The first round compares a part with every entry. From then on the parts of an entry are a ball:
its radius is that of the last assignment widened by the way its centre has moved since. Only
entries whose centre is less than twice the radius away are neighbours of the ball; with integer
squares the tests ``D <= 4 r**2`` are exact. A part closer to its centre than half the way to the
nearest neighbour lies in the stable core and keeps its entry unseen. The others lie in annular
rings, between the half ways to one neighbour and the next, and are compared with the neighbours
up to their ring only. The assignment is the same as that of a full search, ties included.

Spark holds the vectors as a table in the shared folder with their codes, one such table for each
round; tasks compute codes in blocks, and sums and radii are one row for each entry and task,
added up by a shuffle. The driver sees the codebooks, ``parts * entries`` short rows.

Rows whose vector is null or has a null or non-finite component are dropped. Vectors of unequal
length count as filled up with zeros to the longest one's length, which is rounded up to a
multiple of the parts; codebooks start with the smallest ids, a null id last, of rows that repeat
an id those with the smaller components first. A table with fewer rows than entries has smaller
codebooks, an empty one none. Components beyond ``2**30 / sqrt(length)`` count as that bound, so
that squared distances stay whole numbers of 64 bits. Columns of the input are kept in ``_row``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.llm.tables import saved

BLOCK_ROWS = 32_768
# Rings with up to so many neighbours are compared together.
RING_STEPS = (8, 32, 128)


@dataclass(frozen=True)
class Settings:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


@dataclass
class Codebooks:
    """``centres``: part, entry, component. ``radii``: squared radius of each entry's ball, or
    None before the first assignment."""

    centres: np.ndarray
    radii: np.ndarray | None = None

    def sha256(self) -> str:
        """Of all components by part, entry and position, in decimal, joined by commas."""
        listed = ",".join(map(str, self.centres.ravel().tolist()))
        return hashlib.sha256(listed.encode()).hexdigest()


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres, exact. By floating point products where
    every number in between is a whole one below 2**53."""
    span = max(np.abs(points).max(initial=0), np.abs(centres).max(initial=0))
    kind = np.float64 if points.shape[1] * 4 * int(span) ** 2 < 1 << 52 else np.int64
    p, c = points.astype(kind), centres.astype(kind)
    found = (p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]
    return found.astype(np.int64)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre, the lowest of equal ones, and its squared distance."""
    codes = np.zeros(len(points), dtype=np.int64)
    best = np.zeros(len(points), dtype=np.int64)
    for a in range(0, len(points), 4096):
        d = distances(points[a : a + 4096], centres)
        codes[a : a + 4096] = d.argmin(1)
        best[a : a + 4096] = d.min(1)
    return codes, best


class Balls:
    """The balls of one codebook and the neighbours of each, nearest first."""

    def __init__(self, centres: np.ndarray, radii: np.ndarray):
        self.centres = centres
        between = distances(centres, centres)
        np.fill_diagonal(between, np.iinfo(np.int64).max)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.way = np.take_along_axis(between, self.order, axis=1)
        # Farther entries cannot take any part of the ball away.
        self.neighbours = (self.way <= 4 * radii[:, None]).sum(1)

    def assign(self, points: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances of parts that had the codes ``before``."""
        codes = before.copy()
        apart = points - self.centres[before]
        best = (apart * apart).sum(1)
        known = self.neighbours[before]
        # Half the way to the nearest neighbour is where the stable core ends.
        core = (known == 0) | (4 * best < self.way[before, 0])
        rows = np.flatnonzero(~core)
        rows = rows[np.argsort(before[rows], kind="stable")]
        balls, starts = np.unique(before[rows], return_index=True)
        for ball, members in zip(balls.tolist(), np.split(rows, starts[1:])):
            self._rings(ball, members, points, best, codes)
        return codes, best

    def _rings(self, ball, members, points, best, codes) -> None:
        known = int(self.neighbours[ball])
        # The ring of a part: as many neighbours as have their half way within its distance.
        ring = np.searchsorted(self.way[ball, :known], 4 * best[members], side="right")
        below = 0
        for step in (*RING_STEPS, known):
            upto = min(step, known)
            chosen = members[(ring > below) & (ring <= upto)]
            if len(chosen):
                near = np.sort(self.order[ball, :upto])
                code, found = nearest(points[chosen], self.centres[near])
                code = near[code]
                other = (found < best[chosen]) | ((found == best[chosen]) & (code < ball))
                codes[chosen[other]], best[chosen[other]] = code[other], found[other]
            below = upto


def _assigned(books: Codebooks, parts: int):
    """Function for ``mapInArrow``: vectors with their codes and squared distances by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = None
        if books.radii is not None:
            balls = [Balls(c, r) for c, r in zip(books.centres, books.radii)]
        for table in _gathered(batches):
            vectors = _matrix(table["ints"])
            width = vectors.shape[1] // parts
            codes = np.zeros((len(vectors), parts), dtype=np.int64)
            errors = np.zeros((len(vectors), parts), dtype=np.int64)
            old = None if balls is None else _matrix(table["codes"])
            for part in range(parts):
                points = vectors[:, part * width : (part + 1) * width]
                if balls is None:
                    found = nearest(points, books.centres[part])
                else:
                    found = balls[part].assign(points, old[:, part])
                codes[:, part], errors[:, part] = found
            out = table.set_column(table.schema.get_field_index("codes"), "codes", _lists(codes, pa.int32()))
            out = out.set_column(out.schema.get_field_index("errors"), "errors", _lists(errors, pa.int64()))
            yield from out.to_batches()

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Blocks of about BLOCK_ROWS rows: what a task holds at once."""
    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            held.append(batch.slice(at, BLOCK_ROWS))
            rows += held[-1].num_rows
            if rows >= BLOCK_ROWS:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length."""
    joined = pa.concat_arrays(column.chunks)
    return joined.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(joined), -1)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, max(matrix.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), type=kind))


def _summed(parts: int, entries: int):
    """Function for ``mapInArrow``: count, sums and largest distance of each entry in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), dtype=np.int64)
        far = np.zeros((parts, entries), dtype=np.int64)
        sums = None
        for table in _gathered(batches):
            vectors, codes = _matrix(table["ints"]), _matrix(table["codes"])
            errors = _matrix(table["errors"])
            width = vectors.shape[1] // parts
            if sums is None:
                sums = np.zeros((parts, entries, width), dtype=np.int64)
            for part in range(parts):
                own = codes[:, part]
                counts[part] += np.bincount(own, minlength=entries)
                np.maximum.at(far[part], own, errors[:, part])
                order = np.argsort(own, kind="stable")
                used, starts = np.unique(own[order], return_index=True)
                points = vectors[order, part * width : (part + 1) * width]
                sums[part, used] += np.add.reduceat(points, starts, axis=0)
        if sums is None:
            return
        used = np.argwhere(counts > 0)
        part, entry = used[:, 0], used[:, 1]
        columns = [part, entry, counts[part, entry], far[part, entry]]
        arrays = [pa.array(c, type=pa.int64()) for c in columns] + [_lists(sums[part, entry], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "entry", "n", "far", "sums"])

    return run


def _moved(books: Codebooks, assigned: DataFrame, settings: Settings) -> Codebooks:
    """Entries at the floored mean of their parts; unused ones stay."""
    partial = assigned.select("ints", "codes", "errors").mapInArrow(
        _summed(settings.parts, books.centres.shape[1]),
        "part long, entry long, n long, far long, sums array<long>",
    )
    by_component = partial.select("part", "entry", "n", "far", F.posexplode("sums"))
    total = by_component.groupBy("part", "entry", "pos").agg(
        F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("col").alias("col")
    )
    # A row for each component of the codebooks, however many vectors there are.
    found = total.toPandas()
    centres, reach = books.centres.copy(), np.zeros(books.centres.shape[:2])
    at = (found["part"].to_numpy(), found["entry"].to_numpy())
    centres[(*at, found["pos"].to_numpy())] = found["col"].to_numpy() // found["n"].to_numpy()
    reach[at] = np.sqrt(found["far"].to_numpy().astype(np.float64))
    apart = centres - books.centres
    way = np.sqrt((apart * apart).sum(2).astype(np.float64))
    # Rounded up, by more than floating point can lose.
    radii = np.ceil((reach + way) ** 2 * (1 + 1e-9) + 1).astype(np.int64)
    return Codebooks(centres, radii)


class Compression:
    """Codes of all vectors. ``codes()``: ``_row`` with all columns of the input, ``codes`` by
    part and ``errors``, the squared distances; ``books``: the final codebooks."""

    def __init__(
        self,
        vectors: DataFrame,
        vector_id: str = "vec_id",
        vector: str = "embedding",
        keep: tuple[str, ...] = ("vec_id", "label"),
        settings: Settings = Settings(),
    ):
        self.settings = settings
        state = self._integers(vectors, vector_id, vector, keep)
        self.books = self._start(state)
        for _ in range(settings.rounds):
            state = self._assign(state)
            self.books = _moved(self.books, state, settings)
        self._final = self._assign(state)

    def _integers(self, vectors, vector_id, vector, keep) -> DataFrame:
        """``_row, id, ints, codes, errors`` of the usable rows, with one length of ``ints``."""
        x = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
        usable = F.forall(
            "_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
        )
        rows = vectors.select(
            F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"),
            F.col(f"`{vector_id}`").alias("id"),
            x.alias("_x"),
        ).where(F.col("_x").isNotNull() & usable)
        parts = self.settings.parts
        longest = rows.agg(F.max(F.size("_x"))).first()[0] or 0
        self.length = max(-(-longest // parts), 1) * parts
        bound = math.isqrt((1 << 60) // self.length)
        whole = F.transform(
            "_x",
            lambda c: F.floor(
                F.least(F.greatest(c * self.settings.scale, F.lit(float(-bound))), F.lit(float(bound)))
            ).cast("int"),
        )
        filled = F.array_repeat(F.lit(0), F.lit(self.length) - F.size("_x"))
        return saved(
            rows.select(
                "_row",
                "id",
                F.concat(whole, filled).alias("ints"),
                F.array().cast("array<int>").alias("codes"),
                F.array().cast("array<long>").alias("errors"),
            )
        )

    def _start(self, state: DataFrame) -> Codebooks:
        first = (
            state.select("id", "ints")
            .orderBy(F.col("id").asc_nulls_last(), "ints")
            .limit(self.settings.entries)
            .collect()
        )
        shape = (len(first), self.settings.parts, self.length // self.settings.parts)
        rows = np.array([r["ints"] for r in first], dtype=np.int64).reshape(shape)
        return Codebooks(rows.transpose(1, 0, 2))

    def _assign(self, state: DataFrame) -> DataFrame:
        if not self.books.centres.shape[1]:
            return state
        return saved(state.mapInArrow(_assigned(self.books, self.settings.parts), state.schema))

    def codes(self) -> DataFrame:
        return self._final.select("_row", "codes", "errors")

    def decoded(self) -> DataFrame:
        """``_row, decoded``: the vectors that the codes stand for, in units of ``1 / scale``."""
        width = self.length // self.settings.parts
        centres = self.books.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = _matrix(pa.chunked_array([batch.column("codes")])) if batch.num_rows else None
                if codes is None:
                    continue
                entries = [centres[part][codes[:, part]] for part in range(codes.shape[1])]
                flat = np.concatenate(entries, axis=1).reshape(-1, width * len(entries))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row"), _lists(flat, pa.int64())], ["_row", "decoded"]
                )

        rows = self._final.select("_row", "codes")
        row_type = rows.schema["_row"].dataType.simpleString()
        return rows.mapInArrow(run, f"_row {row_type}, decoded array<bigint>")


def with_group_sums(
    coded: DataFrame, group: str, value: str, name: str, broadcast_groups: int = 1 << 16
) -> DataFrame:
    """``coded`` with the sum of ``value`` over its rows of an equal ``group``, nulls together.
    Sums are combined before the exchange; up to a counted number of groups they are sent to the
    tasks, more of them are joined by an exchange, where adaptive execution splits a group with
    very many rows."""
    sums = saved(coded.groupBy(F.col(group).alias("_group")).agg(F.sum(value).alias(name)))
    few = sums.count() <= broadcast_groups
    same = coded[group].eqNullSafe(sums["_group"])
    return coded.join(F.broadcast(sums) if few else sums, same, "left").drop("_group")
