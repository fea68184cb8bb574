"""Numbering and paging per key, with keys of any size, and places in a total order.

Where no key is hot a window by key does it. Else the numbers come from a prefix scan over ranges
(``scan``): they tell the page of a row, and a page is gathered by itself, so no task holds more
of a key than a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotrail.operators.scan import Measures, scanned
from geotrail.operators.sizing import SplitPolicy, settled

HALO = "_halo"  # an extra row, lent from earlier input, that is no part of the data


def numbered(
    df: DataFrame, keys: list[str], order: list[str], policy: SplitPolicy, name: str = "ordinal"
) -> DataFrame:
    """Row number (from 1) in the order of each key."""
    if not policy.applies_to(df, keys):
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    found = scanned(one, keys, order, Measures(sums={name: "_one"}), policy.cut(df))
    return found.drop("_one")


def ranked(
    df: DataFrame,
    order: list[str],
    policy: SplitPolicy | None = None,
    name: str = "position",
    stored: bool = False,
) -> DataFrame:
    """The place (from 1) of each row in the order of the whole table.

    The rows are dealt out by range of ``order``, each range counts its own, and what lies before a
    range is added: no window over the whole table, no task with more than a range. Nulls come
    first. Rows equal in ``order`` get successive places, which of them first is not defined.
    They are counted, sampled and dealt out, so unless they come straight from a table
    (``stored``) they are computed once for all three."""
    policy = policy or SplitPolicy()
    if not stored:
        df = settled(df)
    rows = df.withColumns({"_whole": F.lit(0), "_one": F.lit(1).cast("bigint")})
    found = scanned(rows, ["_whole"], order, Measures(sums={name: "_one"}), policy.cut(df))
    return found.drop("_whole", "_one")


def paged(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    element: Column,
    policy: SplitPolicy,
    name: str,
    page_rows: int = 10_000,
) -> DataFrame:
    """Nest the rows of each key into ordered arrays of at most ``page_rows`` elements.

    ``first_ordinal`` (from 1) says where in the key's sequence the page begins. A key with
    up to ``page_rows`` rows is a single page.
    """
    rows = df.withColumn("_element", F.struct(*[F.col(c) for c in order], element.alias("_e")))
    rows = rows.select(*dict.fromkeys([*keys, *order]), "_element")
    size = F.lit(page_rows).cast("bigint")
    return (
        numbered(rows, keys, order, policy, "_ordinal")
        .withColumn("_page", F.call_function("div", F.col("_ordinal") - 1, size))
        .groupBy(*keys, "_page")
        .agg(F.sort_array(F.collect_list("_element")).alias("_elements"))
        .select(
            *keys,
            (F.col("_page") * size + 1).alias("first_ordinal"),
            F.transform("_elements", lambda s: s["_e"]).alias(name),
        )
    )
