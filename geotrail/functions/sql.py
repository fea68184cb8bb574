"""The geometry as functions of the SQL language.

Each function is an SQL expression under a name, so Catalyst inlines it: a query in plain SQL has
the plan of the same query written with columns, without Python and without a call per row.

=======================================  =========================================================
``gt_point(wkt)``                        point text to ``struct<x,y>``; NULL for anything else
``gt_point_text(x, y)``                  point text
``gt_rings(wkt)``                        polygon text to rings; NULL for anything else
``gt_polygon_text(rings)``               polygon text
``gt_edges(rings)``                      the edges of all rings
``gt_box(edges)``                        closed bounding box ``struct<x0,y0,x1,y1>``
``gt_contains(edges, x, y)``             is the point strictly inside; NULL where an input is
``gt_side(edge, x, y)``                  1 left of the edge's direction, -1 right, 0 on its line
``gt_cell(x, y, size)``                  the grid cell of a point, ``struct<cx,cy>``
``gt_cells(box, size)``                  the cells a box reaches into, at most MAX_CELLS of them
``gt_cell_size(box, per_side)``          power of two at which a box spans at most so many cells
                                         (and one more) on each side
=======================================  =========================================================

A join of points and fences is an equi-join on cells::

    SELECT p.id, f.id FROM points p JOIN
      (SELECT id, edges, explode(gt_cells(gt_box(edges), 8D)) AS cell FROM fences) f
    ON f.cell = gt_cell(p.x, p.y, 8D) WHERE gt_contains(f.edges, p.x, p.y)
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from geotrail.functions import geometry as geo

POINT = "struct<x: double, y: double>"
RINGS = f"array<array<{POINT}>>"
EDGE = "struct<x1: double, y1: double, x2: double, y2: double>"
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
CELL = "struct<cx: bigint, cy: bigint>"
# A box with more cells is refused: its size asks for another cell size.
MAX_CELLS = 1 << 20


def definitions() -> dict[str, tuple[str, str, str]]:
    """Parameters, result type and expression of each function, by name."""
    across = "(floor({0}.{2}1 / {1}) - floor({0}.{2}0 / {1}) + 1)"
    cells = f"{across.format('box', 'size', 'x')} * {across.format('box', 'size', 'y')}"
    columns = "sequence(floor(box.x0 / size), floor(box.x1 / size))"
    rows = "sequence(floor(box.y0 / size), floor(box.y1 / size))"
    pair = f"transform({rows}, cy -> named_struct('cx', cx, 'cy', cy))"
    side = "greatest(box.x1 - box.x0, box.y1 - box.y0, 9.5367431640625e-7D)"
    return {
        "gt_point": ("wkt string", POINT, geo.parse_point_wkt("wkt")),
        "gt_point_text": ("x double, y double", "string", geo.point_wkt("x", "y")),
        "gt_rings": ("wkt string", RINGS, geo.readable_rings("wkt", geo.polygon_rings("wkt"))),
        "gt_polygon_text": (f"rings {RINGS}", "string", geo.polygon_wkt("rings")),
        "gt_edges": (f"rings {RINGS}", f"array<{EDGE}>", geo.ring_edges("rings")),
        "gt_box": (f"edges array<{EDGE}>", BOX, f"if(size(edges) > 0, {geo.bounds('edges')}, null)"),
        "gt_contains": (
            f"edges array<{EDGE}>, x double, y double",
            "boolean",
            f"if(x is null or y is null, null, {geo.contains('edges', 'x', 'y')})",
        ),
        "gt_side": (f"edge {EDGE}, x double, y double", "double", geo.side("edge", "x", "y")),
        "gt_cell": (
            "x double, y double, size double",
            CELL,
            "if(x is null or y is null, null,"
            " named_struct('cx', floor(x / size), 'cy', floor(y / size)))",
        ),
        "gt_cells": (
            f"box {BOX}, size double",
            f"array<{CELL}>",
            f"if({cells} > {MAX_CELLS}, raise_error('the box has too many cells of this size'),"
            f" flatten(transform({columns}, cx -> {pair})))",
        ),
        "gt_cell_size": (
            f"box {BOX}, per_side int",
            "double",
            f"pow(2D, ceil(log2({side} / per_side)))",
        ),
    }


def register(spark: SparkSession, schema: str | None = None) -> list[str]:
    """Define the functions, replacing earlier ones: for the session, or, with ``schema``, for good
    in that schema of the catalogue. Returns their names as a query calls them."""
    names = []
    for name, (parameters, result, body) in definitions().items():
        kind, full = ("TEMPORARY FUNCTION", name) if schema is None else ("FUNCTION", f"{schema}.{name}")
        spark.sql(f"CREATE OR REPLACE {kind} {full}({parameters}) RETURNS {result} RETURN {body}")
        names.append(full)
    return names
