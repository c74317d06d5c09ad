"""Bounded labelled samples and one-dimensional calibration for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most.
SAMPLE_ROWS = 8_000


def held_out(id_col: str, folds: int, fold: int):
    """True for the rows of one fold, by crc32 of the id as text; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, fold: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(label, text) of at most `rows` labelled ids outside the held-out fold, those of the smallest id hashes.

    Only a label of 0 or 1 counts. The ids are few by construction, so they are broadcast.
    """
    ids = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
        .select(F.col("doc_id").alias("labelled_id"), F.col(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("labelled_id"), "labelled_id", "label")
        .limit(rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id")).select("label", "text")


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | x), with smoothed targets so that separable classes stay finite."""
    ones, zeros = float((y == 1).sum()), float((y == 0).sum())
    if not ones or not zeros:
        return 0.0, float(np.log((ones + 1) / (zeros + 1)))
    t = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    scale = float(x.std()) or 1.0
    features = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.array([0.0, np.log((ones + 1) / (zeros + 1))])
    ridge = np.diag([1e-3, 1e-6])

    def loss(w: np.ndarray) -> float:
        z = features @ w
        return float(np.sum(np.logaddexp(0, z) - t * z) + 0.5 * w @ ridge @ w)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -35, 35)))
        gradient = features.T @ (p - t) + ridge @ w
        step = np.linalg.solve(features.T @ (features * (p * (1 - p) + 1e-9)[:, None]) + ridge, gradient)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])
