"""Document fingerprints: bottom-k sketches of word shingle hashes, in built-in functions only.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's shingles,
runs of five words. The smallest of two sketches' hashes are those of the united texts, so
sketches of parts merge, and what two sketches share among the smallest of both estimates the
resemblance of the texts. A text with fewer words than a shingle has one shingle of them all; a
null, empty or blank text has an empty sketch. Equal texts have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotrail.llm.tables import SPACES

K = 128
SHINGLE = 5
MOST_SECTIONS = 1 << 16
SECTION_ROWS = 2_000
QUANTILES = 256


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, in order."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch(hashes: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The sketch of a text from the hashes of its words. ``hashes`` should be a column of its
    own, so that it is computed once."""
    runs = F.transform(
        F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (shingle - 1), F.lit(0))),
        lambda first, i: F.xxhash64(first, *(F.get(hashes, i + n) for n in range(1, shingle))),
    )
    few = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(
        F.array().cast("array<bigint>")
    )
    found = F.when(F.size(hashes) >= shingle, runs).otherwise(few)
    return F.slice(F.sort_array(F.array_distinct(found)), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, shingle: int = SHINGLE):
    """``df`` and the sketch of its column ``text``."""
    hashed = df.withColumn("_words", word_hashes(F.col(text)))
    return hashed.withColumn(name, sketch(F.col("_words"), k, shingle)).drop("_words")


def as_text(found: Column) -> Column:
    """A sketch as 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(found, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def united(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard resemblance of two texts: exact where both have at most ``k``
    shingles. Two texts without shingles resemble each other fully."""
    both = united(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(found: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else by how much of the range
    of hashes the ``k`` smallest take."""
    part = (F.element_at(found, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(found) < k, F.size(found).cast("double")).otherwise((k - 1) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of the first text's shingles that the second has too."""
    shared = resemblance(a, b, k) * distinct_shingles(united(a, b, k), k)
    own = distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / own))


def merged(sketches: DataFrame, keys: list[str], name: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key value, of all its parts together. Equal hashes are combined and
    the smallest are picked before the exchange, so a key may have any number of parts. A key
    whose parts are all empty has an empty sketch."""
    least = Window.partitionBy(*keys).orderBy("_hash")
    hashes = sketches.select(*keys, F.explode_outer(name).alias("_hash")).distinct()
    return (
        hashes.withColumn("_rank", F.row_number().over(least))
        .where(F.col("_rank") <= k + 1)
        .groupBy(*keys)
        .agg(F.slice(F.sort_array(F.collect_list("_hash")), 1, k).alias(name))
    )


def _section(doc_id: Column, bounds: list, per_quantile: int) -> Column:
    """The number of the section of ids that an id lies in; sections follow the order of ids and
    hold about as many each: quantiles, divided evenly."""
    ends = F.array(*(F.lit(b) for b in bounds))
    quantile = F.aggregate(
        ends, F.lit(0), lambda n, b: n + F.when(b <= doc_id, 1).otherwise(0)
    )
    inside = F.least(F.greatest(quantile, F.lit(1)), F.lit(len(bounds) - 1))
    low, high = F.get(ends, inside - 1), F.get(ends, inside)
    part = (doc_id - low).cast("double") / F.greatest(high - low, F.lit(1)).cast("double")
    within = F.floor(F.greatest(F.least(part, F.lit(1.0)), F.lit(0.0)) * (per_quantile - 1))
    # Null ids come after all others in descending order.
    return F.coalesce(inside * per_quantile + within, F.lit(-1)).cast("bigint")


def with_next(
    docs: DataFrame, derive=lambda df: df, taken: tuple[str, ...] = ("text",)
) -> DataFrame:
    """Rows of ``docs`` (``doc_id, text``) with ``next_...`` columns of the row that follows in
    descending order of ids; after the last one comes the first. ``derive`` adds columns to the
    rows once they are dealt out. Rows that repeat an id follow each other in the order of their
    texts' hashes. A table of one row is followed by itself.

    Texts are exchanged once, dealt out by sections of ids; each section also gets the first row
    of the section that follows, so no window reaches over more than a section. Sections are at
    most 65,536, whose first ids are ordered in one task and broadcast.
    """
    counts = docs.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(
            "doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 100_000
        ).alias("bounds"),
    ).first()
    bounds = sorted(set(counts["bounds"] or [0]))
    bounds = bounds if len(bounds) > 1 else [bounds[0], bounds[0] + 1]
    sections = min(MOST_SECTIONS, -(-counts["n"] // SECTION_ROWS))
    per_quantile = max(1, -(-sections // (len(bounds) - 1)))
    placed = docs.select("doc_id", "text").withColumn(
        "_section", _section(F.col("doc_id"), bounds, per_quantile)
    )
    heads = placed.groupBy("_section").agg(F.max("doc_id").alias("_head"))
    downward = Window.orderBy(F.col("_section").desc())
    ends = Window.orderBy(F.col("_section").desc()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    follows = heads.select(
        F.col("_section").alias("_to"),
        F.lead("_section").over(downward).alias("_lead"),
        F.lead("_head").over(downward).alias("_lead_head"),
        F.first("_section").over(ends).alias("_first"),
        F.first("_head").over(ends).alias("_first_head"),
    ).select(
        "_to",
        F.coalesce("_lead", "_first").alias("_from"),
        F.when(F.col("_lead").isNull(), F.col("_first_head"))
        .otherwise(F.col("_lead_head"))
        .alias("_id"),
    )
    guests = (
        placed.join(
            F.broadcast(follows), F.expr("_section = _from and doc_id <=> _id")
        )
        .select("doc_id", "text", F.col("_to").alias("_section"), F.lit(True).alias("_guest"))
    )
    rows = derive(
        placed.withColumn("_guest", F.lit(False)).unionByName(guests).repartition("_section")
    )
    order = Window.partitionBy("_section").orderBy(
        "_guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text")
    )
    following = {f"next_{c}": F.lead(c).over(order) for c in taken}
    return rows.withColumns(following).where(~F.col("_guest")).drop("_section", "_guest")


def edited(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Each document with an edited text and the sketches of both: ``doc_id, n_chars, text,
    edited_text, sketch, edited_sketch, next_sketch``. In the edited text the last half of the
    characters, rounded down, is replaced by as many of the next document's first ones."""
    rows = with_next(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")),
        lambda df: with_sketch(df, "text", "sketch", k, shingle),
        ("text", "sketch"),
    )
    half = F.floor(F.length("text") / 2).cast("int")
    whole = F.length("text").cast("int")
    changed = rows.withColumn("n_chars", F.length("text").cast("bigint")).withColumn(
        "edited_text",
        F.concat(
            F.substring(F.col("text"), F.lit(1), whole - half),
            F.substring(F.col("next_text"), F.lit(1), half),
        ),
    )
    return with_sketch(changed.drop("next_text"), "edited_text", "edited_sketch", k, shingle)
