import random
from fractions import Fraction

import pytest
from conftest import rows
from pyspark.sql import functions as F

from geotrail.functions import geometry as geo
from geotrail.operators.containment import FenceIndex
from geotrail.operators.sizing import SplitPolicy

SQUARE_WITH_HOLE = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"


def strictly_inside(rings, x, y):
    """Brute force over all edges, in exact fractions."""
    x, y, odd = Fraction(x), Fraction(y), False
    for ring in rings:
        corners = [(Fraction(a), Fraction(b)) for a, b in ring]
        for (x1, y1), (x2, y2) in zip(corners, corners[1:]):
            aligned = (x - x1) * (y2 - y1) == (y - y1) * (x2 - x1)
            if aligned and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def text(rings):
    return "POLYGON (" + ", ".join(
        "(" + ", ".join(f"{x!r} {y!r}" for x, y in ring) + ")" for ring in rings
    ) + ")"


@pytest.mark.parametrize("strategy", ["cells", "grid"])
def test_boundary_and_holes(points, fences, strategy):
    cases = {
        (5, 1): True, (3.9, 5): True,
        (0, 5): False, (10, 5): False, (5, 0): False, (5, 10): False,  # on an edge
        (0, 0): False, (10, 10): False,  # on a vertex
        (5, 5): False, (4, 5): False, (5, 6): False, (6, 6): False,  # in the hole, on its edge
        (-1, 5): False, (11, 5): False, (5, 11): False, (5, -1): False,
    }
    index = FenceIndex(fences((7, SQUARE_WITH_HOLE)), strategy)
    pairs = index.pairs(points(*[(1, x, y) for x, y in cases]), ["seq"])
    found = {(r.x, r.y) for r in pairs.collect()}
    assert found == {(float(x), float(y)) for (x, y), inside in cases.items() if inside}


def random_fences(seed, count):
    """Stars, rectangles and slivers of very different sizes, negative coordinates included."""
    rnd = random.Random(seed)
    shapes = {}
    for i in range(count):
        size = 10 ** rnd.uniform(-2, 2)
        cx, cy = rnd.uniform(-100, 100), rnd.uniform(-100, 100)
        if i % 3 == 0:
            a, b, c, d = cx, cx + size, cy, cy + size / 3
            ring = [(a, c), (b, c), (b, d), (a, d), (a, c)]
        elif i % 3 == 1:
            ring = [(cx, cy), (cx + size, cy + size), (cx + size, cy + size * 1.01), (cx, cy)]
        else:
            from math import cos, pi, sin

            radii = [size * rnd.uniform(0.2, 1) for _ in range(9)]
            ring = [
                (cx + r * cos(2 * pi * k / 9), cy + r * sin(2 * pi * k / 9))
                for k, r in enumerate(radii)
            ]
            ring.append(ring[0])
        shapes[i] = [ring]
    return shapes


@pytest.mark.parametrize("seed", [1, 2])
def test_both_plans_equal_brute_force(spark, points, fences, seed):
    shapes = random_fences(seed, 60)
    rnd = random.Random(seed)
    places = [(rnd.uniform(-150, 150), rnd.uniform(-150, 150)) for _ in range(600)]
    # Points at and right beside vertices, where rounding matters most.
    for rings in shapes.values():
        for x, y in rings[0][:3]:
            places += [(x, y), (x + 1e-12, y), (x, y - 1e-12), (x - 1e-3, y + 1e-3)]
    want = {
        (i, f) for i, (x, y) in enumerate(places) for f, r in shapes.items()
        if strictly_inside(r, x, y)
    }
    known = fences(*[(f, text(r)) for f, r in shapes.items()])
    located = points(*[(1, x, y) for x, y in places])
    crowd = SplitPolicy().forced(target_rows=20)
    plans = {
        "cells": FenceIndex(known, "cells"),
        "fine cells": FenceIndex(known, "cells", cells_per_fence=1500),
        "grid": FenceIndex(known, "grid"),
        "salted grid": FenceIndex(known, "grid", crowd),
    }
    for name, index in plans.items():
        got = {(r.seq, r.fence) for r in index.pairs(located, ["seq"]).collect()}
        assert got == want, name


def test_whole_cells_need_no_test(fences):
    index = FenceIndex(fences((1, "POLYGON ((0 0, 64 0, 64 64, 0 64, 0 0))")))
    kinds = index._cells.selectExpr(
        "count_if(size(_whole) = 1 and size(_test) = 0) as whole", "count_if(size(_test) = 1) as test"
    ).first()
    assert kinds.whole > kinds.test


def test_index_stays_within_its_bounds(fences):
    shapes = random_fences(3, 40)
    known = fences(*[(f, text(r)) for f, r in shapes.items()])
    for limit in (400, 4000):
        index = FenceIndex(known, max_entries=limit)
        rows_held = index._cells.selectExpr("sum(size(_whole) + size(_test)) as n").first().n
        assert rows_held <= limit
    beyond = FenceIndex(known, max_entries=30)
    assert beyond.strategy == "grid"
    with pytest.raises(ValueError):
        FenceIndex(known, "cells", max_entries=30)


def test_a_giant_fence_covers_few_cells_of_its_level(fences):
    known = fences(
        (1, "POLYGON ((0 0, 1e9 0, 1e9 1e9, 0 1e9, 0 0))"),
        (2, "POLYGON ((0 0, 0.001 0, 0.001 0.001, 0 0.001, 0 0))"),
    )
    cover = FenceIndex(known, "grid")._levels().groupBy("fence").count().collect()
    assert all(r["count"] <= 25 for r in cover)


def test_invalid_and_null_fences_never_match(points, fences):
    square = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
    index = FenceIndex(fences((1, square, False), (2, square, None), (3, square)))
    assert rows(index.pairs(points((1, 1, 1))), "fence") == [(3,)]


def test_no_fences(points, fences):
    square = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
    for strategy in ("cells", "grid"):
        index = FenceIndex(fences((1, square, False)), strategy)
        assert index.pairs(points((1, 1, 1)), ["seq"]).count() == 0


def test_bad_fence_sets_are_refused(fences):
    square = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
    with pytest.raises(ValueError, match="unique"):
        FenceIndex(fences((1, square), (1, square)))
    with pytest.raises(ValueError, match="unreadable"):
        FenceIndex(fences((1, square), (2, "POLYGON ((0 0, 1 x, 2 2, 0 0))")))


def test_wkt_forms(spark):
    df = spark.createDataFrame(
        [
            (1, "POINT (-3.5 1.0E-5)"),
            (2, "point(4 .5)"),
            (3, "POINT (1)"),
            (4, "LINESTRING (0 0, 1 1)"),
            (5, None),
        ],
        "id int, wkt string",
    ).selectExpr("id", f"{geo.parse_point_wkt('wkt')} as p")
    got = {r.id: r.p and (r.p.x, r.p.y) for r in df.collect()}
    assert got == {1: (-3.5, 1e-5), 2: (4.0, 0.5), 3: None, 4: None, 5: None}
    back = spark.sql(f"select {geo.point_wkt('-3.5D', '1.0E-5D')} as t").first().t
    assert back == "POINT (-3.5 1.0E-5)"


def test_polygon_text_round_trip(fences):
    source = fences((1, SQUARE_WITH_HOLE), (2, "POLYGON ((-1.5 -2, 3e2 0, 1 1, -1.5 -2))"),
                    (3, "POLYGON EMPTY"), (4, "POINT (1 1)"), (5, "POLYGON ((0 0, 1 1, 0 0))"))
    got = {
        r.id: r.t for r in source.selectExpr("id", f"{geo.polygon_wkt('rings')} as t").collect()
    }
    assert got[1] == (
        "POLYGON ((0.0 0.0, 10.0 0.0, 10.0 10.0, 0.0 10.0, 0.0 0.0), "
        "(4.0 4.0, 6.0 4.0, 6.0 6.0, 4.0 6.0, 4.0 4.0))"
    )
    assert got[2] == "POLYGON ((-1.5 -2.0, 300.0 0.0, 1.0 1.0, -1.5 -2.0))"
    assert source.where(F.col("rings").isNull()).count() == 3


def test_points_rounded_onto_sloped_edges(spark, points, fences):
    """Where the determinant of rounded numbers has the wrong sign, or no sign."""
    rnd = random.Random(8)
    # A point of the kind that rounding puts on the wrong side.
    shapes = {0: [[(54.141, 93.915), (38.12, 21.66), (42.212, 2.904), (54.141, 93.915)]]}
    places = [(50.5892778146397, 77.89666865344185)]
    for n in range(1, 40):
        a, b, c = ((round(rnd.uniform(0, 100), 3), round(rnd.uniform(0, 100), 3)) for _ in "abc")
        shapes[n] = [[a, b, c, a]]
    for n in range(4000):
        ring = shapes[n % 40][0]
        (x1, y1), (x2, y2) = ring[n % 3], ring[n % 3 + 1]
        t = rnd.random()
        places.append((x1 + t * (x2 - x1), y1 + t * (y2 - y1)))
    index = FenceIndex(fences(*[(i, text(rings)) for i, rings in shapes.items()]))
    found = index.pairs(points(*[(1, x, y) for x, y in places]), ["seq"])
    got = set(rows(found, "seq", "fence"))
    boxes = {
        i: (min(p[0] for p in r[0]), max(p[0] for p in r[0]), min(p[1] for p in r[0]), max(p[1] for p in r[0]))
        for i, r in shapes.items()
    }
    want = {
        (n, i)
        for n, (x, y) in enumerate(places)
        for i, (a, b, c, d) in boxes.items()
        if a <= x <= b and c <= y <= d and strictly_inside(shapes[i], x, y)
    }
    assert got == want and (0, 0) not in got and len(want) > 1000


def test_side_of_an_edge_against_fractions(spark):
    rnd = random.Random(9)
    cases = []
    for n in range(3000):
        x1, y1, x2, y2 = (rnd.uniform(-100, 100) for _ in range(4))
        if n % 3 == 0:  # a grid of halves, so that many lie exactly on the line
            x1, y1, x2, y2 = (round(2 * v) / 2 for v in (x1, y1, x2, y2))
        t = rnd.choice([0.5, 0.25, rnd.random()])
        x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
        if n % 5 == 0:
            x, y = x + rnd.uniform(-1, 1), y
        cases.append((n, x1, y1, x2, y2, x, y))
    df = spark.createDataFrame(cases, "n int, x1 double, y1 double, x2 double, y2 double, x double, y double")
    edge = "named_struct('x1', x1, 'y1', y1, 'x2', x2, 'y2', y2) as e"
    got = df.selectExpr("n", "x", "y", edge).selectExpr("n", f"cast({geo.side('e', 'x', 'y')} as int) as s")
    signs = {r.n: r.s for r in got.collect()}
    for n, x1, y1, x2, y2, x, y in cases:
        x1, y1, x2, y2, x, y = map(Fraction, (x1, y1, x2, y2, x, y))
        turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        assert signs[n] == (turn > 0) - (turn < 0), n
    assert list(signs.values()).count(0) > 300
