"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: case, look-alike letters of other scripts, and digits
that stand for letters. The lexicon holds whole words and word beginnings whose
documents are mostly toxic among labelled rows; phrases around a match that
only clean rows have are exceptions, which cancel it. The sum of the weights of
the matches is divided by a slowly growing function of the length, and a
logistic curve turns it into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.labelled import SAMPLE_ROWS, fit_logistic, held_out, labelled_sample
from loreweave.runtime import materialize, on_executors

# Letters of other scripts that look like Latin ones, and digits or signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


def fold_table() -> dict[int, str]:
    """One character for one: other ASCII signs become spaces, full-width letters plain ones."""
    table = {i: " " for i in range(128) if not chr(i).isalnum()}
    table |= {0xFF41 + i: chr(0x61 + i) for i in range(26)}
    table |= {ord(k): v for k, v in (LOOKALIKES | SUBSTITUTES).items()}
    return table


FOLDS = fold_table()


def fold(text: str) -> str:
    """A text as the automaton reads it: folded, with a space at either end."""
    return f" {text.lower().translate(FOLDS)} "


@dataclass
class Lexicon:
    """Entries begin with a space; those that also end with one are whole words, others word beginnings."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    offset: float = 0.0


class Matcher:
    """The automaton of a lexicon's entries and exception phrases."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for entry in {**lexicon.weights, **dict.fromkeys(lexicon.exceptions)}:
            self.automaton.add_word(entry, entry)
        self.exceptions = set(lexicon.exceptions)
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(place, weight) of each match that no exception phrase covers."""
        if self.empty:
            return []
        found, spans = [], []
        for end, entry in self.automaton.iter(folded):
            if entry in self.exceptions:
                spans.append((end - len(entry) + 1, end))
            if entry in self.lexicon.weights:
                found.append((end - len(entry) + 1, end, self.lexicon.weights[entry]))
        if spans:
            # one sweep: of the spans that begin at or before a match, the one that reaches furthest covers it or none does
            spans.sort()
            found.sort()
            kept, furthest, i = [], -1, 0
            for match in found:
                while i < len(spans) and spans[i][0] <= match[0]:
                    furthest, i = max(furthest, spans[i][1]), i + 1
                if match[1] > furthest:
                    kept.append(match)
            found = kept
        return [(a, w) for a, _, w in found]

    def load(self, text: str | None) -> float:
        """The summed weights, normalised by length."""
        if not text:
            return 0.0
        folded = fold(text)
        hits = self.hits(folded)
        return sum(w for _, w in hits) / (1 + math.log1p(len(folded) / 1000)) if hits else 0.0

    def score(self, text: str | None) -> float:
        z = self.lexicon.slope * self.load(text) + self.lexicon.offset
        return 1 / (1 + math.exp(-min(max(z, -35), 35)))

    def phrases(self, text: str) -> set[str]:
        """The two-word phrases around each match."""
        folded, out = fold(text), set()
        for start, _ in self.hits(folded):
            end = folded.index(" ", start + 1)
            before = folded[folded.rfind(" ", 0, start) + 1 : start]
            after = folded[end + 1 : folded.find(" ", end + 1)] if end + 1 < len(folded) else ""
            if before:
                out.add(f" {before}{folded[start:end]} ")
            if after:
                out.add(f"{folded[start:end]} {after} ")
        return out


def candidate_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each word and each beginning of 4 to 10 letters, the labelled documents of each class that have it."""

    def flush(counts: list[Counter]) -> Iterator[pd.DataFrame]:
        terms = list(counts[0].keys() | counts[1].keys())
        for first in range(0, len(terms), 20_000):
            part = terms[first : first + 20_000]
            yield pd.DataFrame({"term": part, "clean": [counts[0][t] for t in part], "toxic": [counts[1][t] for t in part]})

    counts = [Counter(), Counter()]
    for batch in batches:
        for label, text in zip(batch["label"], batch["text"], strict=True):
            own = set()
            for w in set(fold(text).split(" ")):
                if 2 <= len(w) <= 40:
                    own.add(f" {w} ")
                    own.update(f" {w[:k]}" for k in range(4, min(10, len(w)) + 1))
            counts[label].update(own)
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield from flush(counts)
                counts = [Counter(), Counter()]
    yield from flush(counts)


def choose_entries(table: pd.DataFrame, n_clean: int, n_toxic: int, sure: float = 2.6, least: float = 0.45) -> dict[str, float]:
    """Entries whose share of toxic documents surely (Wilson bound) exceeds `least`.

    Shorter entries come first. A longer one that they cover is kept only if it
    says more, and then weighs what it adds.
    """
    odds: dict[str, float] = {}
    for term, clean, toxic in table.itertuples(index=False):
        n, z = clean + toxic, sure
        p = toxic / n
        bound = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if bound >= least:
            odds[term] = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    kept: dict[str, float] = {}
    for term in sorted(odds, key=lambda t: (len(t), t)):
        shorter = [odds[term[:k]] for k in range(5, len(term)) if term[:k] in kept]
        gain = odds[term] - max(shorter, default=0.0)
        if gain >= (0.7 if shorter else 0.0):
            kept[term] = gain
    return kept


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = SAMPLE_ROWS) -> Lexicon:
    """Learn the lexicon from at most `rows` labelled documents outside the held-out fold (a documented bound)."""
    sample = materialize(labelled_sample(docs, labels, "toxic", folds, held, rows), "sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    counts = sample.mapInPandas(candidate_counts, "term string, clean long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # with a larger share of clean documents no entry passes the bound
    table = counts.filter((F.col("toxic") >= 6) & (F.col("toxic") >= F.col("clean"))).toPandas()
    lexicon = Lexicon(choose_entries(table, sizes.get(0, 0), sizes.get(1, 0)))

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "load": [matcher.load(t) for t in batch["text"]], "phrases": [sorted(matcher.phrases(t)) for t in batch["text"]]})

    seen = sample.mapInPandas(around, "label int, load double, phrases array<string>").toPandas()
    in_class = [Counter(p for y, ps in zip(seen["label"], seen["phrases"], strict=True) if y == k for p in ps) for k in (0, 1)]
    lexicon.exceptions = sorted(p for p, n in in_class[0].items() if n >= 3 and not in_class[1][p])
    if lexicon.exceptions:
        seen = sample.mapInPandas(around, "label int, load double, phrases array<string>").toPandas()
    lexicon.slope, lexicon.offset = fit_logistic(seen["load"].to_numpy(float), seen["label"].to_numpy(int))
    return lexicon


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.5, lexicon: Lexicon | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Append held_out, score and predicted to every row of docs(doc_id, text, ...).

    A map without a shuffle over whole texts; the lexicon is bounded by the
    sample and broadcast. A lexicon of one's own may be given. A null or empty
    text has no match and gets the lowest score; very long texts are read whole;
    repeated rows are scored alike; an empty table gives an empty table; columns
    of the names of the three results are replaced.
    """
    lexicon = lexicon or fit_toxicity(docs, labels, folds, held, rows)
    shared = on_executors(docs.sparkSession, lexicon)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared())
        for texts in batches:
            yield pd.Series([matcher.score(t) for t in texts], dtype="float64")

    docs = docs.drop("held_out", "score", "predicted")
    return (
        docs.withColumn("held_out", held_out("doc_id", folds, held))
        .withColumn("score", score("text"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
