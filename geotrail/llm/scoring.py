"""Language-model scores of documents, beside those of word frequencies.

The frequencies of words come from all training texts: words are counted per batch of rows, the
counts are added up by hash. The most frequent words are sent to every task; a document's other
words meet their counts in an exchange, which no frequent word is part of.

Texts are encoded once. Subword ids and pairs of their slots are counted over all training rows, and
the model's attention, after a start on a bounded sample, is trained on every window of them in
rounds whose parameters are averaged. Every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.llm import attention
from geotrail.llm.labelled import Fold
from geotrail.llm.subwords import VOCABULARY, encoder
from geotrail.llm.tables import saved
from geotrail.llm.words import blocks, mixed, word_hashes

#: Ids that are counted or trained on together.
IDS_AT_ONCE = 1 << 17
#: The end counts as a token; no word has this hash but by chance.
END = mixed(np.array([1], dtype=np.uint64), 99).view(np.int64)[0]


@dataclass(frozen=True)
class Settings:
    """``sample`` texts of at most ``sample_chars`` characters start the model's training, which
    all training texts go on with; ``frequent`` words at most are held by every task."""

    sample: int = 2000
    sample_chars: int = 50_000
    frequent: int = 1 << 19
    vocabulary: str = VOCABULARY
    shape: attention.Shape = field(default_factory=attention.Shape)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, learnt = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        found = []
        for a, b in blocks(texts):
            words, counts, _ = word_hashes(texts.slice(a, b - a))
            train = np.repeat(learnt[a:b], counts)
            some, place = np.unique(words, return_inverse=True)
            total = np.bincount(place, minlength=len(some))
            found.append((some, np.bincount(place[train], minlength=len(some)), total))
        if not found:
            continue
        words, train, total = (np.concatenate(parts) for parts in zip(*found))
        some, place = np.unique(words, return_inverse=True)
        yield pa.record_batch(
            [
                pa.array(np.append(some.view(np.int64), END)),
                pa.array(
                    np.append(np.bincount(place, train, len(some)).astype(np.int64), learnt.sum())
                ),
                pa.array(
                    np.append(np.bincount(place, total, len(some)).astype(np.int64), len(learnt))
                ),
            ],
            names=["word", "train", "total"],
        )


class Frequent:
    """Counts of the most frequent words, by hash."""

    def __init__(self, words: np.ndarray, train: np.ndarray):
        order = np.argsort(words)
        self.words, train = words[order], train[order]
        self.value = np.log10(train + 1.0)
        self.known = train > 0

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the words are here, ``log10(c + 1)``, and whether they are in training texts;
        nothing for words that are not here."""
        if not len(self.words):
            return np.zeros(len(words), bool), np.zeros(len(words)), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        there = self.words[at] == words
        return there, np.where(there, self.value[at], 0.0), there & self.known[at]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum for each text; ``values`` of all texts in a row."""
    ends = np.cumsum(counts)
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[ends] - total[ends - counts]


def _score(frequent: Frequent, model: attention.Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, encoded = batch.column(0), batch.column(1), batch.column(2)
            for a, b in blocks(texts):
                part = texts.slice(a, b - a)
                words, counts, _ = word_hashes(part)
                words = words.view(np.int64)
                some, place = np.unique(words, return_inverse=True)
                there, value, known = frequent.look_up(some)
                text = np.repeat(np.arange(b - a), counts)
                # Words beyond the frequent ones, with how often a text has each.
                far = ~there[place]
                pairs, times = np.unique(
                    text[far] * np.int64(max(len(some), 1)) + place[far], return_counts=True
                )
                owner, word = np.divmod(pairs, max(len(some), 1))
                offsets = pa.array(np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32))
                # A few texts at a time: what the model holds for an id is far more than a word's.
                held = [
                    (attention.log_probabilities(model, ids, n), n)
                    for ids, n in _some_ids(encoded.slice(a, b - a))
                ]
                score, n_ids = (np.concatenate(parts) for parts in zip(*held))
                score /= np.log(10)
                yield pa.record_batch(
                    [
                        rows.slice(a, b - a),
                        pa.array(counts),
                        pa.array(_sums(value[place], counts)),
                        pa.array(_sums(known[place].astype(np.int64), counts)),
                        pa.array(n_ids + 1),
                        pa.array(score),
                        pa.ListArray.from_arrays(offsets, pa.array(some[word])),
                        pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                    ],
                    names=["doc_id", "words", "value", "known", "ids", "score", "far", "times"],
                )

    return run


def _encode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_all
        for batch in batches:
            texts = batch.column(1)
            for a, b in blocks(texts):
                flat, counts = encode(texts.slice(a, b - a).to_pylist())
                data, ends = flat.astype("<u2").tobytes(), 2 * np.cumsum(counts)
                starts = ends - 2 * counts
                held = [data[i:j] for i, j in zip(starts.tolist(), ends.tolist())]
                columns = [c.slice(a, b - a) for c in batch.columns]
                yield pa.record_batch(
                    [*columns, pa.array(held, pa.binary())], names=[*batch.schema.names, "ids"]
                )

    return run


def encoded(docs: DataFrame, fold: Fold, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text, learnt, ids`` for each row; ``ids`` are little-endian 16-bit numbers."""
    kind, text = (docs.schema[c].dataType.simpleString() for c in ("doc_id", "text"))
    learnt = (~fold.is_held_out(F.col("doc_id"))).alias("learnt")
    return docs.select("doc_id", "text", learnt).mapInArrow(
        _encode(vocabulary), f"doc_id {kind}, text {text}, learnt boolean, ids binary"
    )


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in a row, and how many each has."""
    held = column.to_pylist()
    counts = np.array([len(ids) // 2 for ids in held], dtype=np.int64)
    return np.frombuffer(b"".join(held), dtype="<u2"), counts


def _some_ids(column: pa.Array, most: int = IDS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and counts of a few rows at a time, up to ``most`` ids; a longer text is by itself."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy() // 2
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and held + size > most:
            yield _ids(column.slice(start, row - start))
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield _ids(column.slice(start))


def _count_into(size: int, count):
    """Numbers of one task, added up before they leave it: ``count`` gives them for some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for some in _some_ids(batch.column(0)):
                total += count(*some)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["at", "n"])

    return run


def _counted(ids: DataFrame, size: int, count) -> np.ndarray:
    """The sums of all tasks: ``size`` numbers, whatever the rows."""
    rows = ids.mapInArrow(_count_into(size, count), "at long, n long")
    held = rows.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, dtype=np.int64)
    total[held.column("at").to_numpy()] = held.column("n").to_numpy()
    return total


def _train(model: attention.Model, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (some for batch in batches for some in _some_ids(batch.column(0)))
        seen = attention.passed(model, texts, rate)
        if seen:
            row = attention.packed_parameters(model.p).astype("<f4").tobytes()
            yield pa.record_batch(
                [pa.array([seen]), pa.array([row], pa.binary())], names=["seen", "row"]
            )

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all of a partition: their average by what each has seen."""
    total, mean = 0, None
    for batch in batches:
        for seen, row in zip(batch.column("seen").to_pylist(), batch.column("row")):
            p = np.frombuffer(row.as_buffer(), "<f4").astype(np.float64)
            total += seen
            mean = p if mean is None else mean + (p - mean) * (seen / total)
    if total:
        row = mean.astype("<f4").tobytes()
        yield pa.record_batch(
            [pa.array([total]), pa.array([row], pa.binary())], names=["seen", "row"]
        )


def trained_model(
    rows: DataFrame, settings: Settings = Settings(), groups: int = 16
) -> attention.Model:
    """The model of the rows that are ``learnt``, of ``encoded`` ones.

    What is counted is counted over all of them. Training starts on those with the smallest
    hashes of their ids, without long ones, and then takes every window of all rows once, a part
    of the rows in each round. The driver holds one set of parameters; those of the tasks are
    averaged in ``groups`` and then over these."""
    learnt = rows.where("learnt")
    ids, shape = learnt.select("ids"), settings.shape
    often = _counted(
        ids, attention.IDS, lambda flat, _: np.bincount(flat, minlength=attention.IDS)
    )
    slot_of = attention.slots_of(often)
    pairs = _counted(
        ids,
        attention.SLOTS**2,
        lambda flat, counts: attention.counted_pairs(slot_of, flat, counts).reshape(-1),
    )
    model = attention.counted(often, pairs.reshape(attention.SLOTS, attention.SLOTS), shape)
    # Bounded by the parameter, and so is what gets broadcast.
    chosen = (
        learnt.select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
        .limit(settings.sample)
    )
    start = (
        learnt.where(F.coalesce(F.length("text"), F.lit(0)) <= settings.sample_chars)
        .select("doc_id", "ids")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("ids").alias("ids"))
        .orderBy("doc_id")
        .toArrow()
    )
    attention.train(model, *_ids(start.column("ids").combine_chunks()))
    part = F.pmod(F.xxhash64("ids", "doc_id"), F.lit(shape.rounds))
    packed = "seen long, row binary"
    for number in range(shape.rounds):
        rate = shape.round_rate * (1 - number / shape.rounds)
        of_tasks = (
            learnt.where(part == number)
            .select("ids")
            .mapInArrow(_train(model, rate), packed)
            .withColumn("group", F.pmod(F.spark_partition_id(), F.lit(groups)))
        )
        # Sorted, so that sums do not depend on which task came first.
        of_groups = (
            of_tasks.repartition(groups, "group")
            .sortWithinPartitions("group", "seen", "row")
            .select("seen", "row")
            .mapInArrow(_average, packed)
        )
        found = of_groups.orderBy("seen", "row").toArrow()
        for average in _average(found.to_batches()):
            row = np.frombuffer(average.column("row")[0].as_buffer(), "<f4")
            attention.unpacked_parameters(row, model.p)
            attention.bound(model.p, shape)
    return model


def word_counts(docs: DataFrame, fold: Fold) -> DataFrame:
    """``word, train, total``: how often each word, by hash, and the end are in training texts
    and in all."""
    rows = docs.select("text", (~fold.is_held_out(F.col("doc_id"))).alias("learnt"))
    return (
        rows.mapInArrow(_count, "word long, train long, total long")
        .groupBy("word")
        .agg(F.sum("train").alias("train"), F.sum("total").alias("total"))
    )


def _least_frequent(counts: DataFrame, most: int) -> int:
    """The count from which on words are frequent: at most ``most`` words reach it. Counts are
    told apart in steps of an eighth of a doubling, a few hundred whatever the corpus."""
    step = F.floor(F.log2("total") * 8).cast("int").alias("step")
    steps = counts.groupBy(step).agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("least"))
    held, least = 0, np.iinfo(np.int64).max
    for row in sorted(steps.collect(), key=lambda r: -r["step"]):
        held += row["n"]
        if held > most:
            break
        least = row["least"]
    return int(least)


def scored(docs: DataFrame, fold: Fold, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text`` and others, which are left out): ``doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score, n_ids``.

    Tokens are words, A-Z lower-cased, and one end for each text; a null text is empty. Of the
    ``N`` training tokens, ``V`` distinct ones, a token that occurs ``c`` times there counts
    ``log10((c + 1) / (N + 1 * (V + 1)))``; ``score`` is the model's log10 probability of the
    subword ids and an end. A null id is not held out. Repeated rows are rows like others, and
    count as often. An empty table gives an empty result.
    """
    counts = saved(word_counts(docs, fold))
    totals = counts.agg(
        F.coalesce(F.sum("train"), F.lit(0)).alias("n"),
        F.count(F.when(F.col("train") > 0, 1)).alias("v"),
    ).first()
    least = _least_frequent(counts, settings.frequent)
    held = counts.where(F.col("total") >= least).select("word", "train").toArrow()
    frequent = Frequent(held.column("word").to_numpy(), held.column("train").to_numpy())
    texts = saved(encoded(docs, fold, settings.vocabulary))
    model = trained_model(texts, settings)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = saved(
        texts.select("doc_id", "text", "ids")
        .mapInArrow(
            _score(frequent, model),
            f"doc_id {kind}, words long, value double, known long, ids long, score double,"
            " far array<long>, times array<long>",
        )
        # Written once: these numbers stay with their rows.
        .withColumn("_row", F.monotonically_increasing_id())
    )
    rare = counts.where((F.col("total") < least) & (F.col("train") > 0))
    beyond = (
        rows.select("_row", F.explode(F.arrays_zip("far", "times")).alias("w"))
        .select("_row", F.col("w.far").alias("word"), F.col("w.times").alias("times"))
        .join(rare.select("word", "train"), "word")
        .groupBy("_row")
        .agg(
            F.sum(F.col("times") * F.log10(F.col("train") + 1)).alias("far_value"),
            F.sum("times").alias("far_known"),
        )
    )
    end = counts.where(F.col("word") == int(END)).select("train").first()
    ends = int(end["train"]) if end else 0
    n_tokens = F.col("words") + 1
    base = (
        F.col("value")
        + F.coalesce("far_value", F.lit(0.0))
        + F.lit(float(np.log10(ends + 1.0)))
        - n_tokens * F.lit(float(np.log10(totals["n"] + totals["v"] + 1.0)))
    )
    known = F.col("known") + F.coalesce("far_known", F.lit(0)) + F.lit(int(ends > 0))
    return (
        rows.drop("far", "times")
        .join(beyond, "_row", "left")
        .select(
            "doc_id",
            fold.is_held_out(F.col("doc_id")).alias("held_out"),
            n_tokens.cast("bigint").alias("n_tokens"),
            known.cast("bigint").alias("n_known"),
            F.lit(totals["n"]).cast("bigint").alias("train_tokens"),
            base.alias("base_score"),
            "score",
            F.col("ids").alias("n_ids"),
        )
    )
