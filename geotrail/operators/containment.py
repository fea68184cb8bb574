"""Which fences contain which points.

Two plans give the same result:

* ``cells``: the fences are laid out on one grid whose resolution keeps the whole index
  within a fixed number of entries. The index is broadcast; a point looks up its cell once
  and tests only the fences whose outline meets that cell. No shuffle, no extra rows.
* ``grid``: for fence sets beyond that bound. Every fence lies on the grid level that suits
  its size (so it covers at most 25 cells however large it is) and points are joined to the
  cells of each level by a shuffled equi-join; crowded cells are salted.

Cell sizes are powers of two, so a coordinate's cell and a cell's corners are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.functions import geometry as geo
from geotrail.operators.sizing import SplitPolicy, estimated_bytes, hot_keys, settled

# Bounds on the broadcast index: rows before grouping, and edges held in them.
MAX_ENTRIES = 1 << 20
MAX_EDGES = 1 << 22
CELLS_PER_FENCE = 256
FINE_CELLS_PER_FENCE = 4096
LARGE_INPUT = 1 << 30
# Index rows above which building it is spread over the cluster.
SPREAD_ENTRIES = 1 << 15
EXPONENTS = range(-24, 41)
CELLS_PER_SIDE = 4
LEVEL_STEP = 3


def prepared(fences: DataFrame) -> DataFrame:
    """Valid fences as ``fence, edges, box``; expects ``id, valid, rings``.

    NULL ``valid`` counts as not valid.
    """
    # A generator of one row: Catalyst neither repeats its expression in the projections above
    # nor pushes join key filters through it, which would run the parsing many times over.
    edges = fences.where("coalesce(valid, false)").selectExpr(
        "cast(id as bigint) as fence", f"inline(array(struct({geo.ring_edges('rings')} as edges)))"
    )
    return edges.selectExpr("fence", "edges", f"{geo.bounds('edges')} as box")


@dataclass(frozen=True)
class FenceProfile:
    """What the driver knows about a fence set: totals only, never the fences."""

    fences: int
    box: tuple[float, float, float, float] | None
    exponent: int | None  # cell size 2**exponent of the broadcast grid; None: too big
    levels: tuple[int, ...]


# Grid level of a fence: its longer side spans at most CELLS_PER_SIDE cells.
LEVEL = (
    f"cast(ceil(log2(greatest({{}}, {2.0**-20}D) / {CELLS_PER_SIDE}) / {LEVEL_STEP})"
    f" * {LEVEL_STEP} as int)"
)


def profile(
    fences: DataFrame,
    max_entries: int = MAX_ENTRIES,
    max_edges: int = MAX_EDGES,
    cells_per_fence: int = CELLS_PER_FENCE,
) -> FenceProfile:
    """One pass over the prepared fences. Checks that ids are unique and outlines readable,
    and finds the finest grid that keeps the broadcast index within bounds.

    A box of w by h reaches into at most (w/s + 2)(h/s + 2) cells of size s, so sums over the
    fences bound the index for every s.
    """
    per_fence = fences.selectExpr(
        "fence", "edges is not null as readable", "size(edges) as edges", "box.*"
    )
    per_fence = per_fence.groupBy("fence").agg(
        F.expr("count(1) as copies"),
        F.expr("count_if(not readable) as unreadable"),
        *[F.expr(f"min({c}) as {c}") for c in ("edges", "x0", "y0")],
        *[F.expr(f"max({c}) as {c}") for c in ("x1", "y1")],
    )
    found = (
        per_fence.selectExpr(
            "*",
            "x1 - x0 as w",
            "y1 - y0 as h",
            f"{LEVEL.format('greatest(x1 - x0, y1 - y0)')} as level",
        )
        .selectExpr(
            "count(1) as fences",
            "max(copies) as copies",
            "sum(unreadable) as unreadable",
            "min(x0) as x0",
            "min(y0) as y0",
            "max(x1) as x1",
            "max(y1) as y1",
            "array(sum(w * h), 2 * sum(w + h), 4D * count(1)) as entries",
            "array(sum(edges * w * h), 2 * sum(edges * (w + h)), 4D * sum(edges)) as entry_edges",
            "collect_set(level) as levels",
        )
        .first()
    )
    if not found["fences"]:
        return FenceProfile(0, None, 0, ())
    if found["copies"] > 1:
        raise ValueError("fence ids must be unique among valid fences")
    if found["unreadable"]:
        raise ValueError("some valid fences have an unreadable outline")
    if found["x0"] is None:
        return FenceProfile(found["fences"], None, 0, ())

    def bound(sums: list[float], exponent: int) -> float:
        size = 2.0**exponent
        return sums[0] / size**2 + sums[1] / size + sums[2]

    wanted = min(max_entries, max(cells_per_fence * found["fences"], 1024))
    fitting = [
        k
        for k in EXPONENTS
        if bound(found["entries"], k) <= wanted and bound(found["entry_edges"], k) <= max_edges
    ]
    return FenceProfile(
        found["fences"],
        (found["x0"], found["y0"], found["x1"], found["y1"]),
        fitting[0] if fitting else None,
        tuple(sorted(found["levels"])),
    )


def resolution(points: DataFrame) -> int:
    """Cells per fence worth building for an input: the finer the grid, the fewer points need
    a test, at the price of a larger index."""
    return CELLS_PER_FENCE if estimated_bytes(points) < LARGE_INPUT else FINE_CELLS_PER_FENCE


def _cover(fences: DataFrame, size: str, *kept: str, spread: bool = False) -> DataFrame:
    """One row per fence and cell it reaches into: ``fence, cx, cy, whole, edges`` and ``kept``.

    ``whole``: every point of the cell is inside, no test needed. Otherwise ``edges`` holds
    just the edges that matter for points of this cell. Cells wholly outside are left out.
    """
    columns = "explode(sequence(floor(box.x0 / size), floor(box.x1 / size))) as cx"
    rows = "explode(sequence(floor(box.y0 / size), floor(box.y1 / size))) as cy"
    box = ("a", "b", "c", "d")
    outline = f"exists(edges, e -> {geo.touches_box('e', *box)})"
    inside = geo.contains("edges", "(a + size / 2)", "(c + size / 2)")
    strips = fences.selectExpr("fence", "edges", "box", *kept, f"{size} as size").selectExpr(
        "*", columns
    )
    if spread:
        strips = strips.repartition("fence", "cx")
    return (
        strips.selectExpr("fence", "edges", *kept, "size", "cx", rows)
        .selectExpr("*", "cx * size as a", "cy * size as c")
        .selectExpr("*", "a + size as b", "c + size as d")
        .selectExpr("*", f"case when {outline} then false when {inside} then true end as whole")
        .where("whole is not null")
        .selectExpr(
            "fence", *kept, "cx", "cy", "whole",
            f"if(whole, null, {geo.edges_seen_from_box('edges', *box)}) as edges",
        )
    )


class FenceIndex:
    """Containment against one snapshot of fences.

    ``fences`` has ``id, valid, rings``. ``strategy``: "auto", "cells" or "grid". The fences are
    read once, here, and written to the shared folder: bounds, frame and cells are all of that
    snapshot, and so is every batch of a stream.
    """

    def __init__(
        self,
        fences: DataFrame,
        strategy: str = "auto",
        policy: SplitPolicy | None = None,
        max_entries: int = MAX_ENTRIES,
        max_edges: int = MAX_EDGES,
        cells_per_fence: int = CELLS_PER_FENCE,
    ):
        self.fences = settled(prepared(fences))
        self.policy = policy or SplitPolicy()
        self.cells_per_fence = cells_per_fence
        self.profile = profile(self.fences, max_entries, max_edges, cells_per_fence)
        if strategy == "auto":
            strategy = "cells" if self.profile.exponent is not None else "grid"
        if strategy == "cells" and self.profile.exponent is None:
            raise ValueError("the fence set is beyond the broadcast bound; use the grid strategy")
        self.strategy = strategy
        self._cells = self._cell_directory() if strategy == "cells" else None
        self._leveled: DataFrame | None = None

    # -- broadcast plan ----------------------------------------------------------------

    def _frame(self) -> tuple[int, int, int]:
        x0, y0, _, y1 = self.profile.box
        size = 2.0**self.profile.exponent
        return int(x0 // size), int(y0 // size), int(y1 // size) - int(y0 // size) + 1

    def _cell_number(self, cx: str, cy: str) -> str:
        left, low, rows = self._frame()
        return f"({cx} - {left}L) * {rows}L + ({cy} - {low}L)"

    def _in_box(self) -> str:
        x0, y0, x1, y1 = (f"cast('{v!r}' as double)" for v in self.profile.box)
        return f"x between {x0} and {x1} and y between {y0} and {y1}"

    def _cell_directory(self) -> DataFrame | None:
        """One row per occupied cell: fences that hold all of it, and fences to test."""
        if self.profile.box is None:
            return None
        spread = self.profile.fences * self.cells_per_fence > SPREAD_ENTRIES
        return (
            _cover(self.fences, f"{2.0**self.profile.exponent!r}D", spread=spread)
            .selectExpr("*", f"{self._cell_number('cx', 'cy')} as _cell")
            .groupBy("_cell")
            .agg(
                F.expr("collect_list(if(whole, fence, null)) as _whole"),
                F.expr(
                    "collect_list(if(whole, null, named_struct('fence', fence, 'edges', edges)))"
                    " as _test"
                ),
            )
        )

    def pin(self) -> FenceIndex:
        """Compute the index, broadcast cells or grid cells, once, into the checkpoint folder, for
        use by many micro-batches."""
        if self._cells is not None:
            self._cells = settled(self._cells)
        elif self.strategy == "grid" and self.profile.box is not None:
            self._leveled = settled(self._levels())
        return self

    def inside_sets(self, points: DataFrame) -> DataFrame:
        """Add ``inside``, the ids of the containing fences, to every point. Broadcast plan;
        works on streams as well."""
        if self.strategy != "cells":
            raise ValueError("only the broadcast plan adds the set without a shuffle")
        none = "cast(array() as array<bigint>)"
        if self._cells is None:
            return points.selectExpr("*", f"{none} as inside")
        size = f"{2.0**self.profile.exponent!r}D"
        cell = self._cell_number(f"floor(x / {size})", f"floor(y / {size})")
        passed = f"filter(_test, t -> {geo.contains('t.edges', 'x', 'y')})"
        inside = f"concat(_whole, transform({passed}, t -> t.fence))"
        # Most cells have nothing to test; their points skip the array functions.
        inside = f"case when _cell is null then {none} when size(_test) = 0 then _whole else {inside} end"
        columns = [f"`{c}`" for c in points.columns]
        return (
            points.selectExpr("*", f"if({self._in_box()}, {cell}, null) as _cell")
            .join(F.broadcast(self._cells), "_cell", "left")
            .selectExpr(*columns, f"coalesce({inside}, {none}) as inside")
        )

    # -- shuffled plan -----------------------------------------------------------------

    def _levels(self) -> DataFrame:
        level = LEVEL.format("greatest(box.x1 - box.x0, box.y1 - box.y0)")
        leveled = self.fences.selectExpr("*", f"inline(array(struct({level} as level)))")
        spread = self.profile.fences * (CELLS_PER_SIDE + 1) ** 2 > SPREAD_ENTRIES
        return _cover(leveled, "pow(2D, level)", "level", spread=spread).select(
            "level", "cx", "cy", "fence", "whole", "edges"
        )

    def grid_matches(
        self, points: DataFrame, keep_empty: bool, spread_by: list[str]
    ) -> DataFrame:
        """Points joined with the fences that contain them, column ``fence``.

        With ``keep_empty`` every point also yields one row with a NULL fence. ``spread_by``
        names columns that differ between points.
        """
        if self.profile.box is None:
            nothing = points.selectExpr("*", "cast(null as bigint) as fence")
            return nothing if keep_empty else nothing.where("false")
        mix = f"xxhash64({', '.join(spread_by)})"
        probe = "named_struct('level', {0}, 'cx', {1}, 'cy', {2})"
        probes = ", ".join(
            probe.format(k, f"floor(x / {2.0**k!r}D)", f"floor(y / {2.0**k!r}D)")
            for k in self.profile.levels
        )
        cell = ["level", "cx", "cy"]
        columns = [f"`{c}`" for c in points.columns]
        probed = points.where(self._in_box()).selectExpr(*columns, f"inline(array({probes}))")
        index = self._levels() if self._leveled is None else self._leveled
        on_grid = probed.select(*cell)
        # A stream's rows cannot be counted beforehand; its limit per trigger bounds them.
        if not points.isStreaming and self.policy.applies_to(on_grid, cell):
            crowded = F.broadcast(
                hot_keys(on_grid, cell, self.policy).selectExpr(
                    *cell, "cast(ceil(rows / row_limit) as int) as _salts"
                )
            )
            probed = probed.join(crowded, cell, "left").withColumn(
                "_salt", F.expr(f"cast(pmod({mix}, coalesce(_salts, 1)) as int)")
            )
            index = index.join(crowded, cell, "left").withColumn(
                "_salt", F.expr("explode(sequence(0, coalesce(_salts, 1) - 1))")
            )
            cell = [*cell, "_salt"]
            probed, index = probed.drop("_salts"), index.drop("_salts")
        hit = f"coalesce(whole or {geo.contains('edges', 'x', 'y')}, false)"
        found = probed.join(index, cell).where(hit).selectExpr(*columns, "fence")
        if not keep_empty:
            return found
        # The rows that stand for the points themselves join the others past the exchange by
        # cell, where they could find nothing.
        return found.unionByName(points.selectExpr(*columns, "cast(null as bigint) as fence"))

    def pairs(self, points: DataFrame, spread_by: list[str] | None = None) -> DataFrame:
        """One row per point and containing fence: the points' columns and ``fence``."""
        if self.strategy == "cells":
            return self.inside_sets(points).select(
                *points.columns, F.explode("inside").alias("fence")
            )
        return self.grid_matches(points, False, spread_by or points.columns)


def collect_inside(
    rows: DataFrame, group: list[str], order: list[str], carried: list[str]
) -> DataFrame:
    """Bring grid rows (point, fence or NULL) back to one row per point with its set.

    The rows are first brought together by ``group``, so the window that follows on the same
    keys needs no second exchange. ``order`` identifies the point within its group.
    """
    together = rows.repartition(*[F.col(c) for c in group])
    return together.groupBy(*group, *order).agg(
        *[F.first(c).alias(c) for c in carried],
        F.collect_set("fence").alias("inside"),
    )

