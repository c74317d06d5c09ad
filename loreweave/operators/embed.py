"""Embeddings of texts. An embedder is a function of a text column to an array of doubles; the default hashes words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from loreweave.operators import vectors

DIMENSIONS = 64


@F.pandas_udf(ArrayType(DoubleType()))
def _hashed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    numbers: dict[bytes, int] = {}  # of the words seen, up to a bound

    def number(word: bytes) -> int:
        found = numbers.get(word)
        if found is None:
            found = int(hashlib.md5(word).hexdigest()[:7], 16)
            if len(numbers) < 500_000:
                numbers[word] = found
        return found

    for texts, sizes in batches:
        out = []
        for text, size in zip(texts, sizes, strict=True):
            h = np.fromiter(map(number, (text or "").lower().encode("utf-8", "surrogatepass").split()), np.int64)
            row = np.bincount(h % size, weights=1.0 - 2 * (h // size % 2), minlength=size)
            norm = np.sqrt(row @ row)
            out.append(row / norm if norm else row)
        yield pd.Series(out)


def hashed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Signed feature hashing of the lower-cased words, L2-normalised; a text without words gives zeros.

    A word adds 1 or -1 at one place, both by its MD5. It is deterministic and needs no model, and knows no meaning.
    """
    return _hashed(text, F.lit(dimensions))


def embedded(rows: DataFrame, text: str = "document", embedder: Callable[[Column], Column] = hashed) -> DataFrame:
    """rows with `embedding`."""
    return rows.withColumn("embedding", embedder(F.col(text)))


def nearest(chunks: DataFrame, query: str, k: int, embedder: Callable[[Column], Column] = hashed) -> DataFrame:
    """chunks(id, document, ...) with rank and similarity of the k nearest to a text."""
    asked = chunks.sparkSession.range(1).select(embedder(F.lit(query)).alias("q"))
    return vectors.knn(embedded(chunks, "document", embedder), asked, k, "id")


def near_copies(chunks: DataFrame, text: str, threshold: float = 0.9, k: int = 5) -> DataFrame:
    """Those of the k nearest chunks whose rounded similarity reaches the threshold."""
    return nearest(chunks, text, k).filter(F.round("similarity", 3) >= threshold)
