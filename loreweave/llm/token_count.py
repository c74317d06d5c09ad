"""Token counts by heap-and-linked-list byte-pair merging.

A word is a linked list of symbols. Every adjacent pair that the vocabulary can
merge lies in a heap by rank and place; the lowest is popped, merged, and its
two new neighbour pairs are pushed. A word's tokens are its initial symbols
less its merges, and no token numbers are made.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts are remembered in a Python worker.
CACHE_WORDS = 600_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    chars = {b: chr(b) for b in kept}
    return [chars.get(b) or chr(next(spare)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """What counting needs of a tokenizer file: pair ranks and the special strings.

    Symbols are numbered anew, so that pairs are pairs of small integers:
    byte b is symbol b inside a word and 256 + b at the end of a word.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    end = spec["model"].get("end_of_word_suffix") or ""
    chars = byte_symbols()
    number = {c: b for b, c in enumerate(chars)}
    number.update({c + end: 256 + b for b, c in enumerate(chars)} if end else {})
    ranks: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        made = number.setdefault(left + right, len(number) + 512)
        ranks.setdefault((number[left], number[right]), (rank, made))
    specials = [t["content"] for t in spec["added_tokens"] if t.get("special")]
    return {"ranks": ranks, "specials": specials, "word_end": bool(end)}


class BpeCounter(dict):
    """Counts tokens; as a dict it remembers the counts of white-space separated chunks."""

    #: Pre-tokenization pattern of the word vocabulary (a fixed value).
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, vocabulary: dict) -> None:
        super().__init__()
        self.ranks = vocabulary["ranks"]
        self.word_end = vocabulary["word_end"]
        self.special = regex.compile("|".join(map(regex.escape, vocabulary["specials"])) or r"(?!)")
        self.pieces: dict[str, int] = {}

    def __missing__(self, chunk: bytes) -> int:
        n = self.count_chunk(chunk.decode("utf-8", "surrogatepass"))
        if len(self) < CACHE_WORDS:
            self[chunk] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a text. No piece crosses ASCII white space, so chunks are counted apart."""
        return sum(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))

    def count_chunk(self, chunk: str) -> int:
        total = 0
        if "<|" in chunk:
            total = len(self.special.findall(chunk))
            parts = self.special.split(chunk)
        else:
            parts = [chunk]
        for part in parts:
            # the vocabulary lower-cases each character by itself, so sigma has no final form
            folded = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for piece in self.PIECES.findall(folded):
                n = self.pieces.get(piece)
                if n is None:
                    n = self.count_piece(piece.encode("utf-8", "surrogatepass"))
                    if len(self.pieces) < CACHE_WORDS:
                        self.pieces[piece] = n
                total += n
        return total

    def count_piece(self, data: bytes) -> int:
        """Initial symbols less merges of one piece, in O(n log n)."""
        symbol = list(data)
        n = len(symbol)
        if self.word_end:
            symbol[-1] += 256
        if n < 2:
            return n
        ranks = self.ranks
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (found := ranks.get((symbol[i], symbol[i + 1]))) is not None:
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = nxt[i] if symbol[i] == left else n
            if j >= n or symbol[j] != right:
                continue  # one of the two was merged meanwhile
            merges += 1
            symbol[i], symbol[j] = made, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                if (found := ranks.get((made, symbol[k]))) is not None:
                    heapq.heappush(heap, (found[0], i, made, symbol[k], found[1]))
            h = prev[i]
            if h >= 0 and (found := ranks.get((symbol[h], made))) is not None:
                heapq.heappush(heap, (found[0], h, symbol[h], made, found[1]))
        return n - merges


def token_counts(df: DataFrame, vocabulary_path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Append n_bytes, n_tokens and over_limit to every row.

    The vocabulary is a fixed file; its pair ranks are broadcast once. Whole
    texts are counted, in one map without a shuffle, with memory bounded by the
    batch and the two caches. A null or empty text has 0 bytes and 0 tokens; a
    text of one very long word is counted in O(n log n); repeated rows get equal
    counts; an empty table gives an empty table. Columns of df that have the
    names of the three results are replaced.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    df = df.drop("n_bytes", "n_tokens", "over_limit")

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = BpeCounter(shared.value)
        for texts in batches:
            yield pd.Series([counter.count(t) if t else 0 for t in texts], dtype="int64")

    return (
        df.withColumn("n_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"))
        .withColumn("n_tokens", n_tokens(F.col(text_col)))
        .withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
    )
