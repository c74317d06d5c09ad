"""Words and word numbers shared by the text operators."""

from __future__ import annotations

import numpy as np
import xxhash

#: The largest number of words an interner keeps before it starts anew.
MAX_WORDS = 400_000

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


def ascii_words(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of `width` consecutive entries."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix(out * _M1 + hashes[i : i + n])
    return out


class WordHashes(dict):
    """64-bit hashes of words, remembered for the frequent ones. Memory is bounded by MAX_WORDS."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MAX_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Interner(dict):
    """Numbers words by first appearance, so that what is derived from a word is derived once.

    full() tells when the caller has to start anew to keep memory bounded.
    """

    def __init__(self) -> None:
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def full(self) -> bool:
        return len(self.words) > MAX_WORDS
