"""From raw documents to packed sequences: the stages of the text pipeline, in order.

Each stage takes the documents that the one before kept and gives back rows with the columns of
``documents``; the last one gives pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail import session
from geotrail.llm import exact_dedup, mixing, packing, partenum, toxicity
from geotrail.llm.queries import TOXICITY_FOLD
from geotrail.llm.tables import documents


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labels' own documents, so it
    does not depend on which rows are left."""
    network = toxicity.learnt(
        documents(spark, sf_dir), documents(spark, sf_dir, "labels"), TOXICITY_FOLD
    )
    return (
        toxicity.scored(docs, network).where(~toxicity.is_toxic(F.col("score"))).select("_row.*")
    )


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of resemblance hold together: sets of five-word
    shingles, eight tenths in common or more."""
    return partenum.one_of_each(docs, shingle=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares: a document taken twice is there twice, the last one
    of a source has only the words that are left to its target."""
    mixture = mixing.Mixture(docs).documents().drop("_shard", "_position")
    return mixture.withColumn("n_chars", F.length("text").cast("bigint"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids, with their ids as little-endian
    16-bit numbers. ``copy`` numbers the rows of the mixture, where a document may be twice: the
    pieces of one copy in order of ``start`` are its ids, the pieces of one ``sequence_id`` in
    order of ``offset`` are a sequence."""
    row = F.struct("doc_id", F.monotonically_increasing_id().alias("copy"))
    cut = packing.pieces(docs.withColumn("_copy", row), doc_id="_copy", id_bytes=2)
    return packing.packed(cut).select("doc_id.doc_id", "doc_id.copy", *cut.columns[1:], "sequence_id", "offset")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("source_mixing", mixed),
    ("packing", packed),
]
# A network, a random draw and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each result written and read again."""
    folder = session.run_folder(spark)
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
