"""Geometry as SQL functions."""

import pytest
from conftest import rows

from geotrail.functions import sql
from geotrail.operators.containment import FenceIndex
from geotrail.plans.checked import SQL_PAIRS
from geotrail.sources import sample_tables as sample

SQUARE = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))"


@pytest.fixture(scope="module")
def ask(spark):
    sql.register(spark)
    return lambda text: spark.sql(f"SELECT {text}").first()[0]


def test_text_and_back(ask):
    assert tuple(ask("gt_point('POINT (1.5 -2e3)')")) == (1.5, -2000.0)
    assert ask("gt_point_text(1, 2)") == "POINT (1.0 2.0)"
    assert ask(f"size(gt_rings('{SQUARE}'))") == 2
    assert ask(f"gt_rings(gt_polygon_text(gt_rings('{SQUARE}'))) = gt_rings('{SQUARE}')")
    for bad in ("NULL", "''", "'POINT (1)'", "'POLYGON ((0 0, 1 1))'"):
        assert ask(f"gt_point({bad})") is None
        assert ask(f"gt_rings({bad})") is None


@pytest.mark.parametrize(
    ("x", "y", "inside"),
    [("1", "1", True), ("3", "3", False), ("0", "5", False), ("2", "3", False), ("11", "5", False),
     ("NULL", "1", None)],
)
def test_contains(ask, x, y, inside):
    assert ask(f"gt_contains(gt_edges(gt_rings('{SQUARE}')), {x}, {y})") is inside


def test_nothing_is_contained_in_no_fence(ask):
    assert ask("gt_contains(gt_edges(gt_rings(NULL)), 1, 1)") is None
    assert ask("gt_box(gt_edges(gt_rings(NULL)))") is None
    assert ask("gt_cell(NULL, 1, 8)") is None


def test_cells_of_a_box_hold_the_cells_of_its_points(ask):
    box = "named_struct('x0', -3D, 'y0', 0D, 'x1', 8D, 'y1', 3D)"
    for x, y in ((-3, 0), (8, 3), (0, 1), (-0.5, 2.9)):
        assert ask(f"array_contains(gt_cells({box}, 2D), gt_cell({x}, {y}, 2D))")
    assert ask(f"size(gt_cells({box}, 2D))") == 14
    size = ask(f"gt_cell_size({box}, 4)")
    assert size == 4.0
    with pytest.raises(Exception, match="too many cells"):
        ask(f"gt_cells({box}, 1e-6D)")


def test_side(ask):
    edge = "named_struct('x1', 0D, 'y1', 0D, 'x2', 0.3D, 'y2', 0.9D)"
    assert [ask(f"gt_side({edge}, {p})") for p in ("0, 1", "1, 0", "0, 0")] == [1.0, -1.0, 0.0]


def test_a_query_in_sql_is_inlined_and_joins_by_cell(spark, folder):
    points, fences = sample.locations(spark, folder), sample.fences(spark, folder)
    sql.register(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spark.sql(SQL_PAIRS, locations=points, fences=fences)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "gt_contains" not in plan
    assert not any(w in plan for w in ("Python", "Arrow", "NestedLoop", "Cartesian"))
    index = FenceIndex(sample.outlined_fences(spark, folder))
    want = index.pairs(points).withColumnRenamed("fence", "polygon")
    columns = ("seq", "device", "polygon")
    assert rows(found, *columns) == rows(want, *columns)


def test_functions_of_a_schema_are_there_for_good(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS geometry")
    names = sql.register(spark, "geometry")
    assert "geometry.gt_point" in names
    assert spark.sql("SELECT geometry.gt_point('POINT (1 2)').y").first()[0] == 2.0
    for name in names:
        spark.sql(f"DROP FUNCTION {name}")
