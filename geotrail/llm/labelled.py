"""Bounded samples of labelled texts for fitting, and calibration of what was fitted."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.llm.tables import remainder


@dataclass(frozen=True)
class Fold:
    """Rows with ``crc32(doc_id as text) mod divisor = held_out`` are never learnt from."""

    divisor: int
    held_out: int

    def is_held_out(self, doc_id):
        return F.coalesce(remainder(doc_id, self.divisor) == self.held_out, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, fold: Fold, per_label: int, max_chars: int
) -> DataFrame:
    """``o, i, l, t``: at most ``per_label`` texts ``t`` of each label ``l``, chosen by a hash of
    the id; ``o`` and ``i`` order them, the same wherever the rows are. Texts over ``max_chars`` characters, null
    labels, labels of unknown documents and held-out rows are no part of the sample. A document
    with several labels counts with the largest."""
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
        .where("_id is not null and _label in (0, 1)")
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
        .where(~fold.is_held_out(F.col("_id")))
        .withColumn("_order", F.xxhash64("_id"))
    )
    # Both parts are bounded by the parameter, so is what gets broadcast.
    chosen = known.where("_label = 0").orderBy("_order", "_id").limit(per_label).union(
        known.where("_label = 1").orderBy("_order", "_id").limit(per_label)
    )
    return (
        docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .where(F.length("_text") <= max_chars)
        .groupBy("_id")
        .agg(F.min("_order").alias("o"), F.min("_label").alias("l"), F.min("_text").alias("t"))
        .select("o", F.col("_id").alias("i"), "l", "t")
    )


def in_order(rows: list) -> tuple[list[str], np.ndarray]:
    """Texts and labels of ``training_rows``."""
    rows = sorted(rows, key=lambda r: (r["o"], r["i"]))
    return [r["t"] for r in rows], np.array([r["l"] for r in rows], dtype=np.int64)


def training_texts(
    docs: DataFrame, labels: DataFrame, label: str, fold: Fold, per_label: int, max_chars: int
) -> tuple[list[str], np.ndarray]:
    """Texts and labels of ``training_rows`` at the driver."""
    return in_order(training_rows(docs, labels, label, fold, per_label, max_chars).collect())


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(
    x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3
) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through one feature, by Newton's method."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = logistic(design @ beta)
        gradient = design.T @ (y - p) - ridge * beta
        weight = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(design.T @ (design * weight[:, None]) + ridge * np.eye(2), gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def best_cut(x: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 for "label 1 at or above it", in the middle of its gap."""
    order = np.argsort(-x, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(x) + 1) + y.sum())
    ordered = x[order]
    last = np.append(ordered[1:] < ordered[:-1], True)
    at = int(np.argmax(np.where(last, f1, -1.0)))
    below = ordered[at + 1] if at + 1 < len(x) else ordered[at] - 1.0
    return float((ordered[at] + below) / 2)
