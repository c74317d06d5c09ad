"""Tables of values of 64-bit grams: the frequent ones are broadcast, the others are joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct grams that a task keeps before it sends their counts on.
KEPT_GRAMS = 3_000_000


class GramTable:
    """A value for each gram by open addressing with linear probing; at least half of the slots are free."""

    def __init__(self, grams: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, (2 * len(grams)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, np.nan)
        pending, slots = np.arange(len(grams)), self.home(grams)
        while len(pending):
            free = np.flatnonzero(np.isnan(self.values[slots]))
            taken, at = np.unique(slots[free], return_index=True)
            put = free[at]
            self.keys[taken], self.values[taken] = grams[pending[put]], values[pending[put]]
            pending, slots = np.delete(pending, put), (np.delete(slots, put) + 1) & self.mask

    @property
    def mask(self) -> int:
        return (1 << self.bits) - 1

    def home(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, grams: np.ndarray) -> np.ndarray:
        """The value of each gram; NaN where there is none."""
        slots = self.home(grams)
        out = self.values[slots]
        other = np.flatnonzero((self.keys[slots] != grams) & ~np.isnan(out))
        slots = slots[other]
        while len(other):
            slots = (slots + 1) & self.mask
            got = self.values[slots]
            out[other] = got
            on = (self.keys[slots] != grams[other]) & ~np.isnan(got)
            other, slots = other[on], slots[on]
        return out


class HeadValues:
    """The values of the frequent grams; each worker builds its own table, which costs less than sending it."""

    def __init__(self, grams: np.ndarray, values: np.ndarray) -> None:
        self.grams, self.values, self.table = grams, values, None

    def sums(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The sum of values of each run of grams, and its grams without a value, distinct, with their numbers; starts are where runs begin."""
        if self.table is None:
            self.table = GramTable(self.grams, self.values)
        got = self.table.get(flat)
        missing = np.flatnonzero(np.isnan(got))
        got[missing] = 0
        rest, many = [], []
        cuts = np.searchsorted(missing, np.append(starts, len(flat)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own, n = np.unique(flat[missing[a:b]], return_counts=True) if b > a else (np.empty(0, np.uint64), np.empty(0, np.int64))
            rest.append(own.view(np.int64))
            many.append(n.astype(np.int64))
        return np.add.reduceat(got, starts), rest, many


class GramCounts:
    """Counts of grams of a task in sorted arrays, of bounded size."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, grams: np.ndarray) -> bool:
        """Count grams; True when it is time to send on."""
        self.parts.append(np.unique(grams, return_counts=True))
        if sum(len(g) for g, _ in self.parts) > KEPT_GRAMS:
            self.parts = [self.merged()]
        return len(self.parts[0][0]) > KEPT_GRAMS

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        grams, at = np.unique(np.concatenate([g for g, _ in self.parts]), return_inverse=True)
        return grams, np.bincount(at, weights=np.concatenate([n for _, n in self.parts]), minlength=len(grams)).astype(np.int64)


def least_of_head(counts: DataFrame, most: int) -> int:
    """The least n for which counts(n) has no more than `most` rows of n or over."""
    least, taken = 1 << 62, 0
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        if taken + r["count"] > most:
            break
        least, taken = r["n"], taken + r["count"]
    return least


def head_values(values: DataFrame, most: int) -> HeadValues:
    """Those of values(gram, n, value) that are broadcast: the most frequent, `most` of them at the most."""
    frequent = values.filter(F.col("n") >= least_of_head(values, most)).select("gram", "value").toPandas()
    return HeadValues(frequent["gram"].to_numpy(np.int64).view(np.uint64), frequent["value"].to_numpy(np.float64))


def text_parts(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have about so many characters together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def tail_rows(table: DataFrame) -> DataFrame:
    """(row, gram, times) of table(row, tail, tail_n)."""
    pairs = F.explode(F.arrays_zip("tail", "tail_n")).alias("t")
    return table.filter(F.size("tail") > 0).select("row", pairs).select("row", F.col("t.tail").alias("gram"), F.col("t.tail_n").alias("times"))


def frame(columns: dict[str, list]) -> pd.DataFrame:
    """A frame of columns that may hold arrays."""
    return pd.DataFrame({k: pd.Series(v, dtype=object if v and isinstance(v[0], np.ndarray) else None) for k, v in columns.items()})
