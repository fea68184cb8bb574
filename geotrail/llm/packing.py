"""Packing documents into sequences: shortest-pack-first over the histogram of lengths.

A document is its subword ids and one end id. It is cut at multiples of the sequence length, so
all its pieces but the last one fill a sequence. The lengths of the pieces, from 1 to the sequence
length, are counted, and the counts alone are packed: lengths are placed longest first, each into
packs that have the least in them of those it fits into, always as many packs of a kind at a time
as there are. A pattern is a sequence of lengths with a number of packs of that kind. The pieces
of one length are then ranked, and a rank says which pack of which pattern a piece belongs to.

The histogram has as many rows as a sequence has places, and the patterns are not many more: this
is all that the driver sees. Ranking adds up counts per length and slice of rows before it ranks
within slices, so a length that many pieces share is spread over the slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotrail.llm.subwords import END_ID, VOCABULARY, encoder
from geotrail.llm.tables import giving_back, saved
from geotrail.llm.words import blocks

LENGTH = 1024
SLICES = 256
BLOCK_BYTES = 1 << 20


@dataclass
class Pattern:
    """``packs`` sequences that hold ``lengths`` in this order."""

    lengths: tuple[int, ...]
    packs: int


def padding(filled: int, length: int) -> int:
    """Places left empty by a sequence: none where it ends at a power of two."""
    return 0 if filled & (filled - 1) == 0 else length - filled


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[Pattern]:
    """Patterns that hold each length of the histogram as often as it is counted."""
    # Open packs by what they hold; kinds that hold equally much are used one after the other.
    open_packs: dict[int, list[Pattern]] = {}
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            # The pack with the least in it is the one that keeps the choice of fuller packs,
            # but an exact fit or a power of two leaves nothing empty and comes first.
            fits = [held for held in open_packs if held + size <= length]
            if not fits:
                open_packs.setdefault(size, []).append(Pattern((size,), left))
                break
            held = min(fits, key=lambda h: (padding(h + size, length) > 0, h))
            kind = open_packs[held][-1]
            packs = min(left, kind.packs)
            kind.packs -= packs
            if not kind.packs:
                open_packs[held].pop()
                if not open_packs[held]:
                    del open_packs[held]
            open_packs.setdefault(held + size, []).append(Pattern((*kind.lengths, size), packs))
            left -= packs
    return [kind for held in sorted(open_packs) for kind in open_packs[held]]


def ranges(found: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """Which ranks of a length lie at which place of which packs: ``length, first_rank,
    last_rank, first_sequence, offset``."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for kind in found:
        offset = 0
        for size in kind.lengths:
            first = used.get(size, 0)
            out.append((size, first, first + kind.packs - 1, sequence, offset))
            used[size] = first + kind.packs
            offset += size
        sequence += kind.packs
    return out


def _cut(length: int, vocabulary: str, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_all
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1)
            for a, b in blocks(texts, BLOCK_BYTES):
                flat, counts = encode(texts.slice(a, b - a).to_pylist())
                whole = counts + 1
                ids = np.full(int(whole.sum()), END_ID, dtype=f"<u{id_bytes}")
                keep = np.ones(len(ids), dtype=bool)
                keep[np.cumsum(whole) - 1] = False
                ids[keep] = flat
                cuts = -(-whole // length)
                owner = np.repeat(np.arange(b - a), cuts)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * length
                size = np.minimum(whole[owner] - start, length)
                first = np.cumsum(size) - size
                data = ids.tobytes()
                begin, end = id_bytes * first, id_bytes * (first + size)
                held = [data[i:j] for i, j in zip(begin.tolist(), end.tolist())]
                yield pa.record_batch(
                    [
                        rows.slice(a, b - a).take(pa.array(owner)),
                        pa.array(start),
                        pa.array(size),
                        pa.array(held, pa.binary()),
                        pa.array(whole[owner]),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    return run


def pieces(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    vocabulary: str = VOCABULARY,
    id_bytes: int = 4,
) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens``: the pieces of all documents; ``ids`` are
    little-endian numbers of ``id_bytes`` bytes, which must hold the vocabulary. A null or empty text is the end id alone. Rows that repeat an
    id are documents of their own, with pieces of their own; other columns are left out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        giving_back(_cut(length, vocabulary, id_bytes)),
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long",
    )


def checksum(ids: Column) -> Column:
    """Unsigned CRC-32 of the ids' bytes."""
    return F.crc32(ids)


def packed(cut: DataFrame, length: int = LENGTH, slices: int = SLICES) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``: the place of each piece in the sequences.

    ``cut`` has ``doc_id, start, length`` and any other columns; it is computed once and written
    to the shared folder. Pieces of one length are interchangeable: which of them gets which rank
    is settled by a hash of ``doc_id`` and ``start``. An empty table gives an empty result.
    """
    columns = cut.columns
    cut = saved(
        cut.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "start"), F.lit(slices)).cast("int"))
    )
    counts = saved(cut.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_pieces")))
    histogram = counts.groupBy("length").agg(F.sum("_pieces").alias("n")).collect()
    found = ranges(patterns({r["length"]: r["n"] for r in histogram}, length))
    places = cut.sparkSession.createDataFrame(
        found,
        "_length long, _first long, _last long, _sequence long, offset long",
    )
    below = Window.partitionBy("length").orderBy("_slice")
    slices_of = counts.withColumn("_before", F.sum("_pieces").over(below) - F.col("_pieces")).drop(
        "_pieces"
    )
    within = Window.partitionBy("length", "_slice").orderBy("doc_id", "start")
    ranked = cut.join(slices_of, ["length", "_slice"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(within) - 1
    )
    return _located(ranked, places).select(*columns, "sequence_id", "offset")


def _located(ranked: DataFrame, places: DataFrame) -> DataFrame:
    """Joins ranks with the range that holds them. The ranges are broadcast: their number
    follows the number of lengths, never that of the pieces."""
    ordered = F.sort_array(
        F.collect_list(F.struct("_first", "_sequence", "offset"))
    )
    by_length = places.groupBy("_length").agg(ordered.alias("_ranges"))
    # The last range that starts at or before the rank.
    at = F.expr("aggregate(_ranges, 0, (n, r) -> n + if(r._first <= _rank, 1, 0))")
    hit = F.element_at("_ranges", at)
    return (
        ranked.join(F.broadcast(by_length), F.col("length") == F.col("_length"))
        .withColumn("_hit", hit)
        .withColumn("sequence_id", F.col("_hit._sequence") + F.col("_rank") - F.col("_hit._first"))
        .withColumn("offset", F.col("_hit.offset"))
    )
