"""Quality classifier: naive Bayes support vectors.

Indicators of character 3-grams and of n-grams of word shapes are scaled by
their log-count ratio between the classes; a linear hinge-loss model over them
is fitted by dual coordinate descent; a logistic curve turns its margin into a
score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.labelled import SAMPLE_ROWS, fit_logistic, held_out, labelled_sample
from loreweave.llm.words import Interner, ascii_words, mix
from loreweave.runtime import on_executors

BITS = 18
#: A shape n-gram gives an indicator for each of these shares of the text's n-grams that it reaches.
SHARES = (0.5, 0.25, 0.125, 1 / 16, 1 / 32)
_LEAST, _STEPS = np.array(SHARES)[None, :], np.arange(len(SHARES), dtype=np.uint64)[None, :]


def char_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the 3-grams of each word's characters, its ends marked, one word after another; and how many each word has."""
    marked = [f"\x02{w.decode('utf-8', 'surrogatepass')}\x03" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), np.int64, len(words)))
    last = len(codes) - 2
    inside = word[:last] == word[2:]
    hashes = np.zeros(last, np.uint64)
    for i in range(3):
        hashes = (hashes + codes[i : last + i]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    feature = hashes * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)
    return feature[inside].astype(np.int32), np.bincount(word[:last][inside], minlength=len(words))


def shape(word: bytes) -> int:
    """A small number for a word's length, case and last character."""
    n = len(word)
    length = (n > 1) + (n > 2) + (n > 5) + (n > 9) + (n > 15)
    case = 0 if word.islower() else 1 if word.isupper() else 2 if word[:1].isupper() else 3
    last = word[-1:]
    end = 0 if last.isalpha() else 1 if last in b".," else 2 if last in b"!?" else 3 if last.isdigit() else 4 if last < b"\x80" else 0
    return (length * 4 + case) * 5 + end


class FeatureWords:
    """The words a worker has seen, with the features that each brings."""

    def __init__(self) -> None:
        self.names = Interner()
        self.flat, self.first, self.many = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.shapes = np.empty(0, np.uint64)
        self.stamp = np.zeros(1 << BITS, np.int32)

    def learn(self) -> None:
        if new := self.names.words[len(self.first) :]:
            flat, many = char_features(new)
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(many) - many])
            self.many = np.concatenate([self.many, many])
            self.flat = np.concatenate([self.flat, flat])
            self.shapes = np.concatenate([self.shapes, np.fromiter(map(shape, new), np.uint64, len(new))])

    def features(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The distinct feature numbers of each whole text; an empty one has none. New words are taken together."""
        for start in range(0, len(texts), 200):
            if self.names.full():
                self.__init__()
            part = [self.names.of(ascii_words(t)) for t in texts[start : start + 200]]
            self.learn()
            for at in part:
                yield self.of(at)

    def of(self, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.empty(0, np.int32)
        distinct, first = np.unique(at, return_index=True)
        many = self.many[distinct]
        place = np.repeat(self.first[distinct] - np.cumsum(many) + many, many) + np.arange(many.sum())
        got = [self.flat[place]]
        again = np.ones(len(at), np.uint64)
        again[first] = 0
        again[1:] += np.uint64(2) * (at[1:] == at[:-1])
        row = self.shapes[at] * np.uint64(4) + again + np.uint64(1)
        grams = np.zeros(len(row), np.uint64)
        for n in (1, 2, 3):
            grams = grams[: len(row) - n + 1] << np.uint64(12) | row[n - 1 :]  # exact: a shape takes 12 bits
            ordered = np.sort(grams)
            starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, np.int64)
            share = np.diff(np.append(starts, len(ordered))) / max(1, len(ordered))
            often = share >= SHARES[-1]
            table = mix(ordered[starts[often]][:, None] * np.uint64(8) + _STEPS)
            got.append((table[share[often][:, None] >= _LEAST] >> np.uint64(64 - BITS)).astype(np.int32))
        features = np.concatenate(got)
        number = np.arange(len(features), dtype=np.int32)
        self.stamp[features] = number  # the last of equal ones stays
        return features[self.stamp[features] == number]


@dataclass
class QualityModel:
    weights: np.ndarray  # by feature number, log-count ratios included
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum() / np.sqrt(max(1, len(features))) + self.bias)

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.offset, -35, 35))))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 20, seed: int = 7) -> np.ndarray:
    """Weights of the linear L1-hinge model over sparse rows (index array, value array); the last weight is the bias."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norm = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            gradient = y[i] * float(w[at] @ v) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0:
                alpha[i] = new
                w[at] += step * y[i] * v
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w


def fit(features: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> QualityModel:
    """Fit on four fifths of the rows and calibrate on the others; one class alone gives a constant score."""
    size = 1 << BITS
    y = np.where(labels == 1, 1.0, -1.0)
    if len(y) == 0 or (y == 1).all() or (y == -1).all():
        return QualityModel(np.zeros(size), 0.0, *fit_logistic(np.zeros(len(y)), labels))
    order = np.random.default_rng(11).permutation(len(y))
    train = [i for k, i in enumerate(order) if k % 5]
    if len(set(y[train])) < 2:
        train = list(order)
    counts = {k: np.full(size, smoothing) for k in (1.0, -1.0)}
    for i in train:
        counts[y[i]][features[i]] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    rows = []
    for i in train:
        at = features[i]
        rows.append((np.append(at, size), np.append(ratio[at] / np.sqrt(max(1, len(at))), 1.0)))
    share = (y[train] == 1).mean()
    cost = np.where(y[train] == 1, 0.5 / share, 0.5 / (1 - share))
    w = dual_coordinate_descent(rows, y[train], cost, size + 1)
    model = QualityModel(w[:-1] * ratio, float(w[-1]), 1.0, 0.0)
    check = list(order[::5]) if len(set(y[order[::5]])) == 2 else list(order)
    model.slope, model.offset = fit_logistic(np.array([model.margin(features[i]) for i in check]), labels[check])
    return model


def sample_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = FeatureWords()
    for batch in batches:
        yield pd.DataFrame({"label": batch["label"], "features": list(seen.features(list(batch["text"])))})


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on at most `rows` labelled documents outside the held-out fold (a documented bound)."""
    sample = labelled_sample(docs, labels, "quality", folds, fold, rows).mapInPandas(sample_features, "label int, features array<int>").toPandas()
    # sorted, so that the fit doesn't depend on the order in which tasks end
    got = sorted(((int(y), np.asarray(x, np.int32)) for y, x in zip(sample["label"], sample["features"], strict=True)), key=lambda r: (r[0], len(r[1]), np.sort(r[1]).tobytes()))
    return fit([x for _, x in got], np.array([y for y, _ in got], np.int64))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.7, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Score every document of docs(doc_id, text): doc_id, held_out, score and predicted.

    The score depends on the text alone. It is a map without a shuffle over
    whole texts; the model is a fixed array of 2^18 weights, broadcast once. A
    null or empty text gets the score of a text without features; very long
    texts are read whole; repeated rows are scored alike; an empty table gives
    an empty table, and without labels of both classes the score is constant.
    """
    shared = on_executors(docs.sparkSession, fit_quality(docs, labels, folds, fold, rows))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen, model = FeatureWords(), shared()
        for texts in batches:
            yield pd.Series([model.score(x) for x in seen.features([t or "" for t in texts])], dtype="float64")

    return docs.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
