"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Each step works on what the one before could not tell apart: texts of a length of their own
are unique, so are texts whose first characters differ from all others of their length, and
only the remaining ones have their whole content hashed and compared.

Null and empty texts are equal. An empty table gives an empty result. Columns of the input are
kept apart from the operator's own, so names cannot clash. Only ids, lengths and hashes are
exchanged, and a group of any size is a count and a minimum; memory per task is bounded by the
longest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.llm.tables import SPACES, bucket_flag, saved, whole

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """The text that is compared: a null counts as empty, a run of white space as a blank."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _hashed(docs: DataFrame, doc_id: str, text: str, prefix_chars: int, *kept: Column) -> DataFrame:
    """``doc_id, digest`` and the kept columns; the digest is null where a text is unique."""
    rows = (
        docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("_text"), *kept)
        .withColumn("_length", F.length("_text"))
        .withColumn("_prefix", F.xxhash64(F.substring("_text", 1, prefix_chars)))
    )
    # Equal pairs are counted before anything else is exchanged, so copies of one text are one
    # row of their length.
    sized = saved(rows.groupBy("_length", "_prefix").agg(F.count(F.lit(1)).alias("_rows")))
    lengths = sized.groupBy("_length").agg(F.sum("_rows").alias("_of_length"))
    same_length = sized.join(lengths.where("_of_length > 1"), "_length", "left_semi")
    same_prefix = saved(same_length.where("_rows > 1").select("_length", "_prefix"))
    # The bucket filter finds the rows that are left without an exchange of texts.
    flagged = bucket_flag(rows, same_prefix, ["_length", "_prefix"], "_open")
    return flagged.withColumn("digest", F.when(F.col("_open"), F.sha2("_text", 256))).drop(
        "_text", "_length", "_prefix", "_open"
    )


def duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    more: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept`` and its columns ``more``.

    ``keep_id`` is the smallest id among the rows of an equal text, a null id being the largest.
    Of rows that repeat that id with the same text exactly one is kept.
    """
    # Written once, so the row numbers that break ties between repeated rows stay as they are.
    rows = saved(
        _hashed(docs, doc_id, text, prefix_chars, *more).withColumn(
            "_number", F.monotonically_increasing_id()
        )
    )
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_number"))
    groups = (
        rows.where("digest is not null")
        .groupBy("digest")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    )
    alone = rows.where("digest is null").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        *more,
    )
    compared = (
        rows.where("digest is not null")
        .join(groups, "digest")
        .select(
            "doc_id",
            F.col("first.doc_id").alias("keep_id"),
            "group_size",
            (F.col("first._number") == F.col("_number")).alias("kept"),
            *more,
        )
    )
    return alone.unionByName(compared)


def deduplicated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the smallest id."""
    rows = _hashed(docs, doc_id, text, prefix_chars, whole(docs))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    compared = rows.where("digest is not null")
    groups = compared.groupBy("digest").agg(F.min(order).alias("first"))
    # Texts travel only for rows that share their length and prefix with another one.
    first = (
        compared.join(groups, "digest")
        .where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
        .dropDuplicates(["digest"])
    )
    alone = rows.where("digest is null")
    return alone.select("_row.*").unionByName(first.select("_row.*"))
