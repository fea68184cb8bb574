"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word is a run of letters, A-Z lower-cased. It is embedded as the sum of hashed rows for the
word and for its first 4, 5 and 6 bytes, so that unseen forms of a known stem are near it.
Filters over one, two and three words read the embeddings, each keeps its largest value in the
text (max pooling, over the whole text whatever its length), and a linear layer turns these
into a logit. Embeddings start from the log-odds of their words in the sample and everything is
trained in numpy by Adagrad on a bounded sample of labelled texts. Part of the sample is kept for
calibration: a cut of the logit for each language, which is guessed from the text by function
words; the score is the logistic of the logit above the cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.llm.labelled import Fold, best_cut, logistic, training_texts
from geotrail.llm.tables import give_back_memory, giving_back, whole
from geotrail.llm.words import blocks, mixed, non_letters, word_hashes

PREFIXES = (4, 5, 6)
FEATURES = 1 + len(PREFIXES)
WIDTHS = (1, 2, 3)
BLOCK_BYTES = 512 << 10
CHECKED = 64
#: Common function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with by are this from",
    "de": "der die und den das ist nicht ein mit zu von im für auf dem",
    "fr": "le les et des un une est pour dans que du au par avec ou",
    "es": "el los las que y una para por con del en se un no es",
}


@dataclass(frozen=True)
class Settings:
    """``per_label`` and ``max_chars`` bound the sample that the model is fitted on."""

    per_label: int = 2500
    max_chars: int = 100_000
    bits: int = 15
    dim: int = 8
    filters: int = 8
    epochs: int = 8
    batch: int = 32
    rate: float = 0.1
    calibration: int = 4
    least_for_cut: int = 15
    seed: int = 1


def _function_word_table() -> tuple[np.ndarray, np.ndarray]:
    words = [(w, k) for k, line in enumerate(FUNCTION_WORDS.values()) for w in line.split()]
    counts = {w: sum(w == v for v, _ in words) for w, _ in words}
    only = [(w, k) for w, k in words if counts[w] == 1]
    hashes, _, _ = word_hashes(pa.array([" ".join(w for w, _ in only)]), non_letters())
    order = np.argsort(hashes)
    return hashes[order], np.array([k for _, k in only])[order]


_FUNCTION_HASHES, _FUNCTION_LANGUAGES = _function_word_table()


@dataclass
class Texts:
    """Feature rows of the words of some texts, with two empty words after each text."""

    rows: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    language: np.ndarray


def encoded(texts: pa.Array, bits: int) -> Texts:
    words, counts, cut = word_hashes(texts, non_letters(), PREFIXES)
    n = len(counts)
    rows = np.full((len(words) + 2 * n, FEATURES), 1 << bits, dtype=np.int32)
    text = np.repeat(np.arange(n), counts)
    place = np.arange(len(words)) + 2 * text
    for k, hashes in enumerate((words, *cut)):
        rows[place, k] = mixed(hashes, 30 + k) & np.uint64((1 << bits) - 1)
    starts = np.cumsum(counts + 2) - (counts + 2)
    at = np.minimum(np.searchsorted(_FUNCTION_HASHES, words), len(_FUNCTION_HASHES) - 1)
    known = _FUNCTION_HASHES[at] == words
    votes = np.zeros((n, len(FUNCTION_WORDS)), dtype=np.int64)
    np.add.at(votes, (text[known], _FUNCTION_LANGUAGES[at[known]]), 1)
    language = np.where(votes.max(axis=1, initial=0) > 0, votes.argmax(axis=1), len(FUNCTION_WORDS))
    return Texts(rows, starts, np.maximum(counts, 1), language)


@dataclass
class Network:
    """Parameters; the last embedding row stands for an empty word and stays zero."""

    embedding: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))

    def features(self, texts: Texts) -> tuple[np.ndarray, list[np.ndarray]]:
        """Embedded words, and the filters' values at every place, by width."""
        embedded = np.take(self.embedding, texts.rows[:, 0].astype(np.intp), axis=0)
        for k in range(1, FEATURES):
            embedded += np.take(self.embedding, texts.rows[:, k].astype(np.intp), axis=0)
        values = []
        for kernel, bias in zip(self.kernels, self.biases):
            z = embedded @ kernel[0]
            for o in range(1, len(kernel)):
                z[:-o] += (embedded @ kernel[o])[o:]
            values.append(np.maximum(z + bias, 0, dtype=np.float32))
        return embedded, values

    def pooled(self, texts: Texts, values: list[np.ndarray]) -> np.ndarray:
        bounds = np.stack([texts.starts, texts.starts + texts.sizes], axis=1).reshape(-1)
        return np.concatenate([np.maximum.reduceat(v, bounds)[::2] for v in values], axis=1)

    def logits(self, texts: Texts) -> np.ndarray:
        if not len(texts.starts):
            return np.zeros(0)
        return self.pooled(texts, self.features(texts)[1]) @ self.weights + self.bias

    def scores(self, texts: Texts) -> np.ndarray:
        return logistic(self.logits(texts) - self.cuts[texts.language])


def _joined(parts: list[Texts]) -> Texts:
    before = np.cumsum([0] + [len(part.rows) for part in parts[:-1]])
    return Texts(
        np.concatenate([part.rows for part in parts]),
        np.concatenate([part.starts + n for part, n in zip(parts, before)]),
        np.concatenate([part.sizes for part in parts]),
        np.concatenate([part.language for part in parts]),
    )


def _log_odds(texts: Texts, labels: np.ndarray, size: int) -> np.ndarray:
    """How much more often the texts of label 1 have a row's word than those of label 0."""
    found = np.zeros((2, size))
    stops = np.append(texts.starts[1:], len(texts.rows))
    for label, a, b in zip(labels.tolist(), texts.starts.tolist(), stops.tolist()):
        found[label, np.unique(texts.rows[a:b])] += 1
    zero, one = found
    return np.log((one + 0.5) / ((labels == 1).sum() + 1)) - np.log(
        (zero + 0.5) / ((labels == 0).sum() + 1)
    )


def _initial(texts: Texts, labels: np.ndarray, settings: Settings) -> Network:
    random = np.random.default_rng(settings.seed)
    size = (1 << settings.bits) + 1
    embedding = random.normal(0, 0.05, (size, settings.dim)).astype(np.float32)
    # Rare words have little to say: the prior of the log-odds pulls them to zero.
    embedding[:, 0] = np.clip(_log_odds(texts, labels, size), -3, 6) / (2 * FEATURES)
    embedding[-1] = 0
    kernels, biases = [], []
    for width in WIDTHS:
        kernel = random.normal(0, 0.3, (width, settings.dim, settings.filters))
        kernel[:, 0, : settings.filters // 2] = 1.0 / width
        kernels.append(kernel.astype(np.float32))
        biases.append(np.zeros(settings.filters, np.float32))
    weights = random.normal(0, 0.1, settings.filters * len(WIDTHS)).astype(np.float32)
    return Network(embedding, kernels, biases, weights, 0.0)


def _part(texts: Texts, chosen: np.ndarray) -> Texts:
    stops = np.append(texts.starts, len(texts.rows))[chosen + 1]
    spans = [np.arange(a, b) for a, b in zip(texts.starts[chosen], stops)]
    lengths = np.array([len(s) for s in spans])
    return Texts(
        texts.rows[np.concatenate(spans)],
        np.cumsum(lengths) - lengths,
        texts.sizes[chosen],
        texts.language[chosen],
    )


class _Adagrad:
    def __init__(self, rate: float):
        self.rate, self.seen = rate, {}

    def step(self, name: str, value: np.ndarray, gradient: np.ndarray, at=slice(None)) -> None:
        seen = self.seen.setdefault(name, np.full(value.shape, 1e-2, np.float32))
        seen[at] += gradient**2
        value[at] -= self.rate * gradient / np.sqrt(seen[at])


def _train_step(net: Network, texts: Texts, y: np.ndarray, weight: np.ndarray, ada: _Adagrad):
    embedded, values = net.features(texts)
    pooled = net.pooled(texts, values)
    wrong = (logistic(pooled @ net.weights + net.bias) - y) * weight / weight.sum()
    down = (wrong[:, None] * net.weights[None, :]) * (pooled > 0)
    touched, pull = [], []
    column = 0
    for number, (kernel, value) in enumerate(zip(net.kernels, values)):
        filters = value.shape[1]
        best = np.empty((len(y), filters), dtype=np.int64)
        for i, (a, n) in enumerate(zip(texts.starts.tolist(), texts.sizes.tolist())):
            best[i] = a + value[a : a + n].argmax(axis=0)
        g = down[:, column : column + filters].astype(np.float32)
        gradient = np.empty_like(kernel)
        for o in range(len(kernel)):
            words = embedded[best + o]
            gradient[o] = np.einsum("ifd,if->df", words, g)
            touched.append(texts.rows[best + o].reshape(-1, FEATURES))
            pull.append((g[:, :, None] * kernel[o].T[None]).reshape(-1, kernel.shape[1]))
        ada.step(f"kernel{number}", kernel, gradient)
        ada.step(f"bias{number}", net.biases[number], g.sum(axis=0))
        column += filters
    rows, back = np.unique(np.concatenate(touched).reshape(-1), return_inverse=True)
    total = np.zeros((len(rows), net.embedding.shape[1]), np.float32)
    np.add.at(total, back, np.repeat(np.concatenate(pull), FEATURES, axis=0))
    total[rows == len(net.embedding) - 1] = 0
    ada.step("embedding", net.embedding, total, rows)
    ada.step("weights", net.weights, (wrong[:, None] * pooled).sum(axis=0).astype(np.float32))
    net.bias -= ada.rate * float(wrong.sum())


def fit(texts: list[str], labels: np.ndarray, settings: Settings = Settings()) -> Network | None:
    """Train on a sample and calibrate on every ``calibration``-th text of it. Without texts of
    both labels there is nothing to learn and no network."""
    held = np.arange(len(texts)) % settings.calibration == settings.calibration - 1
    if len({*labels[~held].tolist()}) < 2:
        return None
    held_texts = pa.array(texts, pa.large_string())
    data = _joined(
        [
            encoded(held_texts.slice(a, b - a), settings.bits)
            for a, b in blocks(held_texts, BLOCK_BYTES)
        ]
    )
    learning = np.flatnonzero(~held)
    y = labels[learning]
    train = _part(data, learning)
    net = _initial(train, y, settings)
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    ada, random = _Adagrad(settings.rate), np.random.default_rng(settings.seed)
    for _ in range(settings.epochs):
        order = random.permutation(len(learning))
        for a in range(0, len(order), settings.batch):
            some = order[a : a + settings.batch]
            _train_step(net, _part(train, some), y[some], weight[some], ada)
    chosen = np.flatnonzero(held) if len({*labels[held].tolist()}) == 2 else learning
    # A few texts at a time: the values of all filters at all places are many times the texts.
    parts = [_part(data, chosen[a : a + CHECKED]) for a in range(0, len(chosen), CHECKED)]
    logits, truth = np.concatenate([net.logits(part) for part in parts]), labels[chosen]
    guessed = np.concatenate([part.language for part in parts])
    net.cuts[:] = best_cut(logits, truth)
    for language in range(len(FUNCTION_WORDS)):
        own = guessed == language
        if min((truth[own] == 1).sum(), (truth[own] == 0).sum()) >= settings.least_for_cut:
            net.cuts[language] = best_cut(logits[own], truth[own])
    return net


def score_texts(net: Network | None, texts: pa.Array, settings: Settings) -> np.ndarray:
    """Scores from 0 to 1 of whole texts; null and empty ones have that of a text without
    words. Without a network every score is 0."""
    if net is None:
        return np.zeros(len(texts))
    parts = [
        net.scores(encoded(texts.slice(a, b - a), settings.bits))
        for a, b in blocks(texts, BLOCK_BYTES)
    ]
    return np.round(np.concatenate(parts) if parts else np.zeros(0), 6)


def scored(
    docs: DataFrame, net: Network | None, settings: Settings = Settings(), text: str = "text"
) -> DataFrame:
    """``_row`` with all columns of a row of ``docs`` in one, and ``score``."""
    rows = docs.select(whole(docs))
    # A text travels once, as a part of its row, unless it is no string there.
    apart = dict(docs.dtypes).get(text) != "string"
    if apart:
        rows = docs.select(whole(docs), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            scores = score_texts(net, batch.column(1) if apart else row.field(text), settings)
            yield pa.record_batch([row, pa.array(scores)], names=["_row", "score"])

    row_type = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(giving_back(run), f"_row {row_type}, score double")


def learnt(
    docs: DataFrame, labels: DataFrame, fold: Fold, settings: Settings = Settings()
) -> Network | None:
    """The network of a bounded sample of labelled texts."""
    network = fit(
        *training_texts(docs, labels, "toxic", fold, settings.per_label, settings.max_chars),
        settings,
    )
    give_back_memory()
    return network


def is_toxic(score: Column) -> Column:
    return score >= 0.5
