"""Quality: a classifier by compression with dictionaries of good and of bad text.

Two Zstandard dictionaries are built from labelled text, one of each label. A text is cut into
pieces, each piece is compressed with both, and the difference of the two compressed sizes, over
the size of the text, says which kind it is more like. Pieces keep what a text repeats of itself
from hiding what it shares with a dictionary, and bound the memory of very long texts. A logistic
curve fitted on other labelled texts than the dictionaries' turns the difference into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.llm.labelled import Fold, fit_logistic, logistic, training_texts
from geotrail.llm.tables import whole
from geotrail.llm.words import text_bytes


@dataclass(frozen=True)
class Settings:
    """``per_label`` and ``max_chars`` bound the sample that the dictionaries come from. From
    ``least_pieces`` pieces of both labels on, dictionaries are trained, to at most one part in
    ``share`` of the smaller side. A text counts as if it had ``prior_bytes`` more of what is
    usual, so the few bytes of a very short one do not decide."""

    per_label: int = 2000
    max_chars: int = 100_000
    piece_bytes: int = 1024
    dictionary_bytes: int = 112 << 10
    least_pieces: int = 40
    share: int = 6
    prior_bytes: int = 48
    level: int = 3


@dataclass
class Dictionaries:
    good: bytes
    bad: bytes
    trained: bool
    usual: float = 0.0
    slope: float = 0.0
    intercept: float = 0.0


def pieces(data: bytes, size: int) -> list[bytes]:
    return [data[a : a + size] for a in range(0, len(data), size)]


def _dictionaries(sides: list[list[bytes]], settings: Settings) -> Dictionaries:
    """Trained dictionaries, or from few texts their bytes as they are; equally long ones, as a
    longer one would compress anything better."""
    parts = [[p for t in side for p in pieces(t, settings.piece_bytes)] for side in sides]
    least = min(sum(map(len, side)) for side in parts)
    if min(map(len, parts)) >= settings.least_pieces:
        size = max(1024, min(settings.dictionary_bytes, least // settings.share))
        return Dictionaries(
            *(zstandard.train_dictionary(size, side).as_bytes() for side in parts), trained=True
        )
    size = min(settings.dictionary_bytes, least)
    return Dictionaries(*(b"".join(side)[-size:] for side in parts), trained=False)


class Compressors:
    """Both dictionaries ready for use; made once for each task."""

    def __init__(self, found: Dictionaries, settings: Settings):
        kind = zstandard.DICT_TYPE_AUTO if found.trained else zstandard.DICT_TYPE_RAWCONTENT
        self.settings, self.found = settings, found
        self.compressors = []
        for content in (found.good, found.bad):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=kind)
            dictionary.precompute_compress(level=settings.level)
            self.compressors.append(
                zstandard.ZstdCompressor(
                    level=settings.level,
                    dict_data=dictionary,
                    write_checksum=False,
                    write_content_size=False,
                    write_dict_id=False,
                )
            )

    def difference(self, data: bytes) -> float:
        """Bytes that the bad dictionary needs more than the good one, per byte of text."""
        good, bad = (c.compress for c in self.compressors)
        total = sum(len(bad(p)) - len(good(p)) for p in pieces(data, self.settings.piece_bytes))
        prior = self.settings.prior_bytes
        return (total + prior * self.found.usual) / (len(data) + prior)

    def score(self, differences: np.ndarray) -> np.ndarray:
        return logistic(self.found.slope * differences + self.found.intercept)


def fit(
    texts: list[str], labels: np.ndarray, settings: Settings = Settings()
) -> Dictionaries | None:
    """Dictionaries from every other text of each label, and the curve from the rest; None
    without enough texts of both labels."""
    data = [t.encode() for t in texts]
    turn = np.zeros(len(texts), dtype=np.int64)
    for label in (0, 1):
        turn[labels == label] = np.arange((labels == label).sum()) % 2
    sides = [[d for d, y, t in zip(data, labels, turn) if y == k and t == 0 and d] for k in (1, 0)]
    rest = [(d, y) for d, y, t in zip(data, labels, turn) if t == 1]
    if not sides[0] or not sides[1] or len({int(y) for _, y in rest}) < 2:
        return None
    found = _dictionaries(sides, settings)
    compressors = Compressors(found, settings)
    found.usual = float(np.median([compressors.difference(d) for d, y in rest if y == 1]))
    differences = np.array([compressors.difference(d) for d, _ in rest])
    truth = np.array([y for _, y in rest], dtype=np.float64)
    scale = max(float(differences.std()), 1e-9)
    slope, intercept = fit_logistic(differences / scale, truth)
    found.slope, found.intercept = slope / scale, intercept
    return found


def scored(
    docs: DataFrame,
    found: Dictionaries | None,
    settings: Settings = Settings(),
    text: str = "text",
) -> DataFrame:
    """``_row`` with all columns of a row of ``docs`` in one, and ``score`` from 0 to 1, higher
    where label 1 is likelier. Null and empty texts have the score of a usual good text; without
    dictionaries every score is 0.5."""
    rows = docs.select(F.col(text).cast("string").alias("_text"), whole(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(found, settings) if found is not None else None
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if compressors is not None and batch.num_rows:
                data, ends = text_bytes(batch.column(0))
                scores = compressors.score(
                    np.array(
                        [
                            compressors.difference(data[a:b].tobytes())
                            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())
                        ]
                    )
                )
            yield pa.record_batch([batch.column(1), pa.array(scores)], names=["_row", "score"])

    row_type = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row {row_type}, score double")


def learnt(
    docs: DataFrame, labels: DataFrame, fold: Fold, settings: Settings = Settings()
) -> Dictionaries | None:
    texts, known = training_texts(
        docs, labels, "quality", fold, settings.per_label, settings.max_chars
    )
    return fit(texts, known, settings)
