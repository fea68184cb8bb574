"""Fences, categories and users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geotrail import schemas
from geotrail.functions import geometry as geo


def with_outline(fences: DataFrame) -> DataFrame:
    """Parse the ``wkt`` text of fences into ``rings``."""
    rings = fences.withColumn("rings", F.expr(geo.polygon_rings("wkt")))
    return rings.withColumn("rings", F.expr(geo.readable_rings("wkt", "rings")))


def jdbc_options(
    url: str,
    user: str,
    password: str,
    table: str,
    query: str | None = None,
    ids: tuple[int, int] | None = None,
    parts: int = 32,
) -> dict:
    """Options of a read; with the range of ``ids`` it is done in so many parts at a time."""
    source = f"({query}) AS rows" if query else table
    options = {"url": url, "user": user, "password": password, "dbtable": source}
    options["fetchsize"] = "10000"
    if ids is None:
        return options
    low, high = ids
    return {
        **options,
        "partitionColumn": "id",
        "lowerBound": str(low),
        "upperBound": str(high + 1),
        "numPartitions": str(max(1, min(parts, high - low + 1))),
    }


def id_range_query(table: str) -> str:
    return f"SELECT min(id) AS low, max(id) AS high FROM {table}"


def fence_query(table: str = "polygons") -> str:
    """The database turns outlines into text."""
    return f"SELECT id, creation, valid, category, ST_AsText(fence) AS wkt FROM {table}"


def _read_jdbc(
    spark: SparkSession, login: tuple[str, str, str], table: str, schema: StructType, query=None
) -> DataFrame:
    def read(options: dict) -> DataFrame:
        return spark.read.format("jdbc").options(**options).load()

    found = read(jdbc_options(*login, table, id_range_query(table))).first()
    ids = None if found["low"] is None else (int(found["low"]), int(found["high"]))
    rows = read(jdbc_options(*login, table, query, ids))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_fences_jdbc(
    spark: SparkSession, url: str, user: str, password: str, table: str = "polygons"
) -> DataFrame:
    """Fence snapshot from a spatial database, read by ranges of ids."""
    login = url, user, password
    return with_outline(_read_jdbc(spark, login, table, schemas.FENCE_ROW, fence_query(table)))


def read_categories_jdbc(
    spark: SparkSession, url: str, user: str, password: str, table: str = "category_polygons"
) -> DataFrame:
    return _read_jdbc(spark, (url, user, password), table, schemas.CATEGORY_ROW)


def read_users_jdbc(
    spark: SparkSession, url: str, user: str, password: str, table: str = "users"
) -> DataFrame:
    return _read_jdbc(spark, (url, user, password), table, schemas.USER_ROW)


def read_dump(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a database dump: tab-separated, ``\\N`` for NULL, ``t``/``f`` for booleans."""
    text = ", ".join(f"`{name}` string" for name in schema.fieldNames())
    rows = spark.read.csv(path, schema=text, sep="\t", nullValue="\\N", quote="", escape="")
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def fences_from_rows(spark: SparkSession, rows: list) -> DataFrame:
    """Fences ``(id, wkt, creation, valid, category)`` given by hand."""
    return with_outline(spark.createDataFrame(rows, schemas.FENCE_ROW))
