"""Periodic runs of words: found by a grammar of the text, and cut to their first period.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are the same) that is at
least ``max(least_words, repeats * q)`` words long and that no word before or after it extends.
Recompression (``recompression``) gives a run-length grammar of the words. For each period ``p``
every run holds a pair of places ``i`` and ``i + p`` with ``i`` on a grid as wide as the shortest
run less ``p``, so the pairs to look at are a harmonic sum. Where the words at both places are the
same, the grammar's common extensions to the left and to the right give the whole stretch at once.
A stretch found with several periods counts with the smallest: the others are multiples of it.

Words are ``[^\\x20\\x09-\\x0D]+``. A null, empty or blank text and one of fewer than
``least_words`` words has no run; its collapsed text is its words with one blank between them.
Each row gives one row, whatever its id; an empty table gives none. Work is done in blocks of
texts; memory per task grows with the longest text, and pairs are looked at in bounded numbers.
Columns that are kept are apart in ``_row``, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.llm.recompression import Grammar
from geotrail.llm.words import blocks

PAIRS_AT_ONCE = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass(frozen=True)
class Rule:
    """What counts as a run."""

    least_words: int = 24
    repeats: int = 3


@dataclass
class Runs:
    """Runs of several texts, ordered by text, start and period."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """Words of all texts as numbers, equal for equal words."""
    flat = pa.array([w for words in texts for w in words], type=pa.large_binary())
    return flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _fenced(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words with a symbol of its own before each text and after the last; where texts start."""
    starts = np.cumsum(sizes) - sizes + np.arange(1, len(sizes) + 1)
    out = np.empty(len(words) + len(sizes) + 1, dtype=np.int64)
    fence = np.append(starts - 1, len(out) - 1)
    out[fence] = words.max(initial=-1) + 1 + np.arange(len(fence))
    inside = np.ones(len(out), dtype=bool)
    inside[fence] = False
    out[inside] = words
    return out, starts


def _pairs(sizes: np.ndarray, starts: np.ndarray, rule: Rule):
    """``i, j, p`` of the grid's pairs of places, in bounded numbers."""
    periods = sizes // rule.repeats
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    grid = np.maximum(rule.least_words, rule.repeats * period) - period
    count = np.maximum((sizes[text] - 1 - period) // grid + 1, 0)
    ends = np.cumsum(count)
    at = 0
    while at < len(text):
        done = ends[at - 1] if at else 0
        upto = max(int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")), at + 1)
        own = count[at:upto]
        entry = np.repeat(np.arange(at, upto), own)
        nth = np.arange(len(entry)) - np.repeat(np.cumsum(own) - own, own)
        i = starts[text[entry]] + nth * grid[entry]
        yield i, i + period[entry], period[entry]
        at = upto


def find_runs(texts: list[list[bytes]], rule: Rule = Rule()) -> Runs:
    """The runs of each of the texts, given as words."""
    long = [n for n, words in enumerate(texts) if len(words) >= rule.least_words]
    none = np.zeros(0, dtype=np.int64)
    if not long:
        return Runs(none, none, none, none)
    sizes = np.array([len(texts[n]) for n in long], dtype=np.int64)
    symbols, starts = _fenced(_numbered([texts[n] for n in long]), sizes)
    grammar = Grammar(symbols)
    found = []
    for i, j, p in _pairs(sizes, starts, rule):
        same = symbols[i] == symbols[j]
        i, j, p = i[same], j[same], p[same]
        right = grammar.extend(i, j, 1)
        left = grammar.extend(i - 1, j - 1, -1)
        length = left + p + right
        enough = length >= np.maximum(rule.least_words, rule.repeats * p)
        stretch = np.stack([(i - left)[enough], length[enough], p[enough]], axis=1)
        found.append(np.unique(stretch, axis=0))
    all_found = np.unique(np.concatenate(found), axis=0)
    # In order of start, length and period, so the first of a stretch has the smallest period.
    first = np.append(True, (all_found[1:, :2] != all_found[:-1, :2]).any(axis=1))[: len(all_found)]
    start, length, period = all_found[first].T
    text = np.searchsorted(starts, start, side="right") - 1
    order = np.lexsort((period, start))
    text, start, length, period = (x[order] for x in (text, start, length, period))
    return Runs(np.array(long)[text], start - starts[text], length, period)


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(start):
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return [words[n] for n in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _found(rule: Rule):
    """Function for ``mapInArrow``."""

    def block(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        # Bytes are split at ASCII white space only, which is what separates words here.
        words = [(t or "").encode().split() for t in texts.to_pylist()]
        runs = find_runs(words, rule)
        bounds = np.searchsorted(runs.text, np.arange(len(words) + 1))
        short = [
            b" ".join(collapsed(own, runs.start[a:b], runs.length[a:b], runs.period[a:b]))
            for own, a, b in zip(words, bounds[:-1].tolist(), bounds[1:].tolist())
        ]
        columns = [pa.array(c, type=pa.int64()) for c in (runs.start, runs.length, runs.period)]
        listed = pa.ListArray.from_arrays(
            pa.array(bounds, type=pa.int32()), pa.StructArray.from_arrays(columns, fields=list(RUN))
        )
        return listed, pa.array(short, type=pa.binary()).cast(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in blocks(texts):
                out = block(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row")[a:b], *out], ["_row", "runs", "collapsed"]
                )

    return run


def periodic_runs(
    docs: DataFrame, keep: tuple[str, ...], text: str = "text", rule: Rule = Rule()
) -> DataFrame:
    """``_row`` with the columns ``keep``, ``runs`` (start, length and period in words, by start
    and period) and ``collapsed``, the text without what repeats within a run."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"), F.col(f"`{text}`").alias("text")
    )
    row = rows.schema["_row"].dataType.simpleString()
    run = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return rows.mapInArrow(_found(rule), f"_row {row}, runs {run}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length for its period, compared in whole numbers; of equal ones
    the first. Null without runs."""
    better = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.reduce(
        runs, F.get(runs, 0), lambda best, r: F.when(better(best, r), r).otherwise(best)
    )


def as_text(runs: Column) -> Column:
    """A line ``start,length,period`` for each run."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
