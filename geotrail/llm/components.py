"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.llm.tables import saved


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for edges ``u, v``: the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours and then the label of that
    label, so paths shorten by halves. Rounds are written to the shared folder; nothing but a
    flag comes to the driver. A node with very many edges is a minimum, combined before the
    exchange, and a joined side that adaptive execution may split.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = saved(both.where("u <> v").distinct())
    labels = saved(
        both.groupBy(F.col("u").alias("node"))
        .agg(F.min("v").alias("least"))
        .select("node", F.least("node", "least").alias("component"))
    )
    changed = True
    while changed:
        near = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "node").select(
            "node", "component", F.least("component", "near").alias("next")
        )
        above = labels.select(
            F.col("node").alias("next"), F.col("component").alias("beyond")
        )
        moved = saved(
            step.join(above, "next", "left").select(
                "node",
                F.least("next", F.coalesce("beyond", "next")).alias("component"),
                (F.least("next", F.coalesce("beyond", "next")) < F.col("component")).alias("moved"),
            )
        )
        changed = not moved.where("moved").isEmpty()
        labels = moved.select("node", "component")
    return labels
