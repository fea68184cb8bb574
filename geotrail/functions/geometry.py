"""Planar geometry as Spark SQL expressions.

A polygon is an array of edges over all its rings, holes included. A point is
inside when a ray towards larger x crosses an odd number of edges and the point
lies on none of them. On which side of an edge a point lies is decided without
error: by the determinant in floating point where its error bound allows, else
by exact sums of products in parts, as Shewchuk's adaptive predicates do.

The functions take and return SQL text, which nests better than column objects do and is
parsed once by Spark; wrap the result in ``F.expr``.
"""

from __future__ import annotations

NUMBER = r"[-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?"
POINT_PATTERN = rf"(?i)^\\s*POINT\\s*\\(\\s*({NUMBER})\\s+({NUMBER})\\s*\\)\\s*$"
POLYGON_PATTERN = (
    r"(?is)^\\s*POLYGON\\s*\\(\\s*\\(([^()]*(?:\\)\\s*,\\s*\\([^()]*)*)\\)\\s*\\)\\s*$"
)

# Added to the crossing count for a point that lies on an edge.
ON_EDGE = 1 << 40
# Share by which cell tests are widened, so that rounding can only move a cell
# from "decided" to "test each point".
SLACK = "1e-9D"


def point_wkt(x: str, y: str) -> str:
    """``POINT (x y)``."""
    return f"concat('POINT (', cast({x} as string), ' ', cast({y} as string), ')')"


def parse_point_wkt(wkt: str) -> str:
    """Point text to ``struct<x,y>``; NULL for anything else."""
    part = f"try_cast(regexp_extract({wkt}, '{POINT_PATTERN}', {{}}) as double)"
    return (
        f"if({wkt} rlike '{POINT_PATTERN}', "
        f"named_struct('x', {part.format(1)}, 'y', {part.format(2)}), null)"
    )


def polygon_rings(wkt: str) -> str:
    """Polygon text to rings, ``array<array<struct<x,y>>>``, with NULL for unreadable numbers."""
    number = "try_cast(get(split(trim(v), '\\\\s+'), {}) as double)"
    vertex = f"named_struct('x', {number.format(0)}, 'y', {number.format(1)})"
    body = f"regexp_extract({wkt}, '{POLYGON_PATTERN}', 1)"
    rings = f"split({body}, '\\\\)\\\\s*,\\\\s*\\\\(')"
    return f"transform({rings}, r -> transform(split(r, ','), v -> {vertex}))"


def readable_rings(wkt: str, rings: str) -> str:
    """``rings`` where the text is a polygon, all numbers are readable and every ring has at
    least four vertices; else NULL."""
    broken = f"exists({rings}, r -> size(r) < 4 or exists(r, p -> p.x is null or p.y is null))"
    return f"if({wkt} rlike '{POLYGON_PATTERN}' and not {broken}, {rings}, null)"


def polygon_wkt(rings: str) -> str:
    """Rings to polygon text."""
    vertex = "concat_ws(' ', cast(p.x as string), cast(p.y as string))"
    ring = f"concat('(', array_join(transform(r, p -> {vertex}), ', '), ')')"
    return f"concat('POLYGON (', array_join(transform({rings}, r -> {ring}), ', '), ')')"


def ring_edges(rings: str) -> str:
    """All edges of all rings; an open ring is closed."""
    corners = "zip_with(r, concat(slice(r, 2, size(r)), slice(r, 1, 1)), (a, b) -> {})"
    edge = "named_struct('x1', a.x, 'y1', a.y, 'x2', b.x, 'y2', b.y)"
    edges = f"flatten(transform({rings}, r -> {corners.format(edge)}))"
    return f"filter({edges}, e -> e.x1 <> e.x2 or e.y1 <> e.y2)"


def bounds(edges: str) -> str:
    """Closed bounding box ``struct<x0,y0,x1,y1>``; every vertex starts some edge."""
    side = "array_{}(transform({}, e -> e.{}))"
    return (
        f"named_struct('x0', {side.format('min', edges, 'x1')}, "
        f"'y0', {side.format('min', edges, 'y1')}, "
        f"'x1', {side.format('max', edges, 'x1')}, "
        f"'y1', {side.format('max', edges, 'y1')})"
    )


# Relative error of the determinant of two rounded products of rounded differences.
SIDE_ERROR = "3.3306690738754716e-16D"
# Splits a double into two halves whose products are exact.
SPLITTER = "134217729D"


def _halves(v: str) -> tuple[str, str]:
    high = f"({SPLITTER} * {v} - ({SPLITTER} * {v} - {v}))"
    return high, f"({v} - {high})"


def _exact_product(a: str, b: str) -> str:
    """``array(error, product)``, whose exact sum is ``a * b``."""
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    error = f"({al} * {bl} - ((({a} * {b} - {ah} * {bh}) - {al} * {bh}) - {ah} * {bl}))"
    return f"array({error}, {a} * {b})"


def exact_sign(products: list[tuple[str, str]]) -> str:
    """The sign of a sum of products of doubles, without rounding.

    The terms are added one at a time to a list of parts that do not overlap, from the smallest
    to the largest; the last part that is not zero has the sign of the whole. Holds while no
    product under- or overflows.
    """
    factors = ", ".join(f"named_struct('a', {a}, 'b', {b})" for a, b in products)
    terms = f"flatten(transform(array({factors}), t -> {_exact_product('t.a', 't.b')}))"
    total = "(s.q + v)"
    error = f"((s.q - ({total} - ({total} - s.q))) + (v - ({total} - s.q)))"
    added = (
        "aggregate(parts, named_struct('q', term, 'h', cast(array() as array<double>)), "
        f"(s, v) -> named_struct('q', {total}, 'h', array_append(s.h, {error})), "
        "s -> array_append(s.h, s.q))"
    )
    return (
        f"aggregate({terms}, cast(array() as array<double>), (parts, term) -> {added}, "
        "parts -> signum(aggregate(parts, 0D, (last, v) -> if(v <> 0D, v, last))))"
    )


def side(e: str, x: str, y: str) -> str:
    """Sign of the turn from an edge to a point: 1 left of its direction, -1 right, 0 on its
    line."""
    left = f"(({e}.x2 - {e}.x1) * ({y} - {e}.y1))"
    right = f"(({e}.y2 - {e}.y1) * ({x} - {e}.x1))"
    exact = exact_sign(
        [
            (f"{e}.x1", f"{e}.y2"), (f"(-{e}.x2)", f"{e}.y1"),
            (f"{e}.x2", y), (f"(-{x})", f"{e}.y2"),
            (x, f"{e}.y1"), (f"(-{e}.x1)", y),
        ]
    )
    return (
        f"case when abs({left} - {right}) > {SIDE_ERROR} * (abs({left}) + abs({right}))"
        f" then signum({left} - {right}) else {exact} end"
    )


def contains(edges: str, x: str, y: str) -> str:
    """True when (x, y) is strictly inside; boundary points are outside."""
    spans = f"(e.y1 > {y}) <> (e.y2 > {y})"
    # Most edges are decided by their box; the side is only asked within it.
    step = (
        f"n + case when {y} < least(e.y1, e.y2) or {y} > greatest(e.y1, e.y2)"
        f" or {x} > greatest(e.x1, e.x2) then 0L"
        f" when {x} < least(e.x1, e.x2) then if({spans}, 1L, 0L)"
        f" else aggregate(array({side('e', x, y)}), 0L, (m, turn) -> case"
        f" when turn = 0 then {ON_EDGE}L"
        f" when {spans} and (turn > 0) = (e.y2 > e.y1) then 1L else 0L end) end"
    )
    # The result of the fold is odd and below ON_EDGE only for a point inside.
    return f"aggregate({edges}, 0L, (n, e) -> {step}, n -> n < {ON_EDGE}L and n % 2 = 1)"


def touches_box(e: str, a: str, b: str, c: str, d: str) -> str:
    """Could the edge meet the closed box [a,b] x [c,d]? May say yes too often, never too
    seldom."""
    ex, ey = f"(abs({a}) + abs({b})) * {SLACK}", f"(abs({c}) + abs({d})) * {SLACK}"
    overlaps = (
        f"greatest({e}.x1, {e}.x2) >= {a} - {ex} and least({e}.x1, {e}.x2) <= {b} + {ex} and "
        f"greatest({e}.y1, {e}.y2) >= {c} - {ey} and least({e}.y1, {e}.y2) <= {d} + {ey}"
    )
    dx, dy = f"({e}.x2 - {e}.x1)", f"({e}.y2 - {e}.y1)"
    sides = ", ".join(
        f"{dx} * ({py} - {e}.y1) - {dy} * ({px} - {e}.x1)" for px in (a, b) for py in (c, d)
    )
    reach = " + ".join(
        [f"abs({v})" for v in (a, b, c, d)] + [f"abs({e}.{v})" for v in ("x1", "x2", "y1", "y2")]
    )
    margin = f"(abs({dx}) + abs({dy})) * ({reach}) * {SLACK}"
    apart = f"least({sides}) > {margin} or greatest({sides}) < -{margin}"
    return f"({overlaps} and not ({apart}))"


def edges_seen_from_box(edges: str, a: str, b: str, c: str, d: str) -> str:
    """The edges that can decide the test for a point of the box: those that share its rows
    and are not wholly to its left."""
    ex, ey = f"(abs({a}) + abs({b})) * {SLACK}", f"(abs({c}) + abs({d})) * {SLACK}"
    return (
        f"filter({edges}, e -> greatest(e.x1, e.x2) >= {a} - {ex} and "
        f"greatest(e.y1, e.y2) >= {c} - {ey} and least(e.y1, e.y2) <= {d} + {ey})"
    )
