"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets: each source gets a share of the words wanted by its weight, at most ``most`` times
   its size; what is above is shared again by weight among the others until none is above.
2. Blocks: the documents of a source are dealt by a hash into disjoint blocks. A source that is
   wanted more than once gives all its blocks once per whole repeat; for the rest its blocks are
   permuted and taken until the words are reached, the last one cut to the exact number.
3. Tree: the block quotas of all sources are split between the two halves of the output shards
   by a multivariate-hypergeometric draw, and again, down to single shards. Each shard thus has
   a draw without replacement from the whole mix, and the quotas add up exactly.
4. The blocks of a source go to the shards in the order of a permutation, as many to each as its
   quota says; within a shard the documents are shuffled by a hash.

All draws depend only on the seed, so a task that runs again draws the same. Hot sources spread
over their blocks; a source's words are added up before any exchange. Only one row per source
reaches the driver: the sources are what the weights are given for, thousands at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotrail.llm.tables import WORD, saved, whole


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in the order of their names, null last."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: float = 2.0
    blocks: int = 4096
    shard_words: int = 1 << 22
    seed: int = 20


def targets(sizes: list[int], mix: Mix) -> list[float]:
    """Words wanted of each source."""
    weight = np.array([mix.weights[i % len(mix.weights)] for i in range(len(sizes))], float)
    limit = np.array(sizes, float) * mix.most
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = mix.share * sum(sizes)
    while free.any() and left > 0:
        part = left * weight / weight[free].sum()
        above = free & (part > limit)
        if not above.any():
            out[free] = part[free]
            break
        out[above] = limit[above]
        left -= limit[above].sum()
        free &= ~above
    return out.tolist()


def shard_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple:
    """Where the blocks of one shard begin and end in the permuted order of each source: the
    way from the root of the splitting tree to the leaf ``shard``."""
    low, high = 0, shards
    begin, held = np.zeros(len(quotas), dtype=np.int64), quotas.copy()
    while high - low > 1:
        middle = (low + high) // 2
        random = np.random.default_rng([seed, low, high])
        taken = int(held.sum()) * (middle - low) // (high - low)
        # The marginals method takes any number of blocks in constant memory.
        left = random.multivariate_hypergeometric(held, taken, method="marginals")
        if shard < middle:
            held, high = left, middle
        else:
            begin, held, low = begin + left, held - left, middle
    return begin, begin + held


def _shards(quotas: np.ndarray, shards: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                begin, end = shard_quotas(quotas, shards, shard, seed)
                some = np.flatnonzero(end > begin)
                yield pa.record_batch(
                    [
                        pa.array(some),
                        pa.array(np.full(len(some), shard)),
                        pa.array(begin[some]),
                        pa.array(end[some]),
                    ],
                    names=["source", "shard", "begin", "end"],
                )

    return run


def _cut_to(text, words):
    """The first ``words`` words of a text with the white space before and between them."""
    found = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(found, F.lit(1), words.cast("int")), "")


class Mixture:
    """One mix of a table of documents.

    A null text has no words and is never taken, nor are other texts without words. A null
    source is a source of its own and the last one. Rows that repeat an id share a block and
    are taken like others; a null id is an id. An empty table gives empty results.
    """

    def __init__(
        self,
        docs: DataFrame,
        mix: Mix = Mix(),
        doc_id: str = "doc_id",
        text: str = "text",
        source: str = "source",
    ):
        self.docs, self.mix, self.spark = docs, mix, docs.sparkSession
        self.columns = doc_id, text, source
        # Written once: a number of its own stays with each row, whatever its id.
        self.counted = saved(self._counted(F.monotonically_increasing_id().alias("number")))
        names = self.counted.groupBy("name").agg(F.sum("size").alias("size")).collect()
        # Python compares strings by code point.
        names.sort(key=lambda r: (r["name"] is None, r["name"] or ""))
        sizes = [r["size"] for r in names]
        self.sources = self.spark.createDataFrame(
            [
                (i, r["name"], r["size"], t)
                for i, (r, t) in enumerate(zip(names, targets(sizes, mix)))
            ],
            "source int, source_name string, source_size long, target double",
        )

    def _counted(self, *more) -> DataFrame:
        doc_id, text, source = self.columns
        words = F.regexp_count(F.col(text), F.lit(WORD)).cast("bigint")
        return self.docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("name"),
            F.coalesce(words, F.lit(0).cast("bigint")).alias("size"),
            F.pmod(F.xxhash64(F.lit(self.mix.seed), F.col(doc_id)), F.lit(self.mix.blocks)).alias(
                "block"
            ),
            *more,
        )

    def _placed(self, rows: DataFrame) -> DataFrame:
        # As many rows as there are sources, and these were on the driver before.
        sources = F.broadcast(self.sources)
        return rows.join(sources, F.expr("name <=> source_name")).drop("name")

    def sizes(self, *more: str) -> DataFrame:
        """``doc_id, size, source_size, target`` for each row of the documents, and its ``number``
        if asked for."""
        return self._placed(self.counted).select(
            "doc_id", "size", "source_size", "target", *more
        )

    def draws(self) -> DataFrame:
        """``source, block, copy, limit, shard``: each time a block is taken. ``limit`` is the
        number of words where the block is cut, else null."""
        seed, words = self.mix.seed, F.sum("size").alias("words")
        per_block = self.counted.where("size > 0").groupBy("name", "block").agg(words)
        permuted = Window.partitionBy("source").orderBy(
            F.xxhash64(F.lit(seed + 1), "source", "block"), "block"
        )
        wanted = (
            self._placed(per_block)
            .withColumn("goal", F.round("target").cast("bigint"))
            .withColumn("repeats", F.expr("goal div source_size"))
            .withColumn("rest", F.expr("goal % source_size"))
            .withColumn("before", F.sum("words").over(permuted) - F.col("words"))
            .withColumn("copies", F.expr("repeats + if(before < rest, 1, 0)"))
            .where("copies > 0")
            .withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
            .withColumn(
                "limit",
                F.expr("if(copy = repeats and rest - before < words, rest - before, null)"),
            )
        )
        order = Window.partitionBy("source").orderBy(
            F.xxhash64(F.lit(seed + 2), "source", "block", "copy"), "block", "copy"
        )
        drawn = saved(
            wanted.withColumn("place", F.row_number().over(order).cast("bigint") - 1).select(
                "source", "block", "copy", "limit", "place", "words"
            )
        )
        held = drawn.groupBy("source").agg(
            F.count(F.lit(1)).alias("blocks"),
            F.sum(F.coalesce("limit", "words")).alias("words"),
        )
        quotas = np.zeros(self.sources.count(), dtype=np.int64)
        total = 0
        for row in held.collect():
            quotas[row["source"]] = row["blocks"]
            total += row["words"]
        shards = int(max(1, min(quotas.sum(), -(-total // self.mix.shard_words))))
        shares = (
            self.spark.range(shards)
            .mapInArrow(
                _shards(quotas, shards, seed), "source long, shard long, begin long, end long"
            )
            .select(
                F.col("source").cast("int"),
                "shard",
                F.explode(F.expr("sequence(begin, end - 1)")).alias("place"),
            )
        )
        return saved(
            drawn.join(shares, ["source", "place"]).select(
                "source", "block", "copy", "limit", "shard"
            )
        )

    def _taken(self, rows: DataFrame) -> DataFrame:
        taken = self._placed(rows.where("size > 0")).join(self.draws(), ["source", "block"])
        whole_blocks = taken.where("limit is null").withColumn("words", F.col("size"))
        order = Window.partitionBy("source", "block", "copy").orderBy(
            F.xxhash64(F.lit(self.mix.seed + 3), "doc_id"), "doc_id"
        )
        cut = (
            taken.where("limit is not null")
            .withColumn("words", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("words", F.expr("least(size, limit - (words - size))"))
            .where("words > 0")
        )
        return whole_blocks.unionByName(cut).drop("limit", "source_name")

    def taken(self) -> DataFrame:
        """``doc_id, number, copy, words, size, shard`` and the source's columns: a row for each time a
        document is taken, without its text."""
        return self._taken(self.counted)

    def documents(self) -> DataFrame:
        """The mix: ``_shard, _position`` and the columns of the documents. A document that is
        taken twice is there twice; one that is cut has the first of its words."""
        doc_id, text, _ = self.columns
        place = Window.partitionBy("shard").orderBy(
            F.xxhash64(F.lit(self.mix.seed + 4), "doc_id", "copy"), "doc_id", "copy"
        )
        rows = self._taken(self._counted(whole(self.docs)))
        cut = F.when(
            F.col("words") < F.col("size"), _cut_to(F.col(f"_row.{text}"), F.col("words"))
        ).otherwise(F.col(f"_row.{text}"))
        return rows.select(
            F.col("shard").alias("_shard"),
            F.row_number().over(place).alias("_position"),
            *(
                cut.alias(text) if c == text else F.col(f"_row.`{c}`").alias(c)
                for c in self.docs.columns
            ),
        )
