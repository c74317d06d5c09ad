"""A compressed full-text index over word numbers: suffix order, wavelet matrix and backward search, in numpy."""

from __future__ import annotations

import numpy as np


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the lexicographic order of one or two rank arrays."""
    key = keys[0] if len(keys) == 1 else keys[0] * (keys[1].max() + 1) + keys[1]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
    return out


def _after(rank: np.ndarray, by: int) -> np.ndarray:
    """The rank of what starts `by` places later; 0, below all, after the end."""
    return np.append(rank[by:] + 1, np.zeros(min(by, len(rank)), np.int64))


def prefix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes by their first `length` symbols, by doubling."""
    power, done, out, at = _dense(text), 1, None, 0
    while True:
        if length & done:
            out = power if out is None else _dense(out, _after(power, at))
            at += done
        if done * 2 > length:
            return out
        power, done = _dense(power, _after(power, done)), done * 2


class WaveletMatrix:
    """Bit planes of a sequence with counts every 64 places, so that the rank of a symbol takes one look-up a plane."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits, self.words, self.counts, self.zeros = bits, [], [], []
        for b in range(bits - 1, -1, -1):
            plane = (values >> b & 1).astype(np.uint8)
            packed = np.packbits(np.append(plane, np.zeros(-len(plane) % 64 + 64, np.uint8)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.append(0, np.cumsum(np.bitwise_count(packed).astype(np.int64)))[:-1])
            self.zeros.append(int(len(plane) - plane.sum()))
            values = np.concatenate([values[plane == 0], values[plane == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        below = self.words[level][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.counts[level][word] + np.bitwise_count(below)

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before lo and before hi."""
        start = np.zeros_like(lo)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            a, b, s = self._ones(level, lo), self._ones(level, hi), self._ones(level, start)
            z = self.zeros[level]
            lo, hi, start = np.where(one, z + a, lo - a), np.where(one, z + b, hi - b), np.where(one, z + s, start - s)
        return lo - start, hi - start


class FmIndex:
    """An index of strings of symbols >= 1, each with a value; a 0 ends each string."""

    def __init__(self, strings: list[np.ndarray], values: np.ndarray, width: int) -> None:
        self.width = width
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        text = np.zeros(int(self.lengths.sum()) + len(strings), np.int64)
        for s, at in zip(strings, self.starts, strict=True):
            text[at : at + len(s)] = s
        self.text = text
        group = prefix_ranks(text, width)
        order = np.argsort(_dense(group, _after(_dense(text), width)), kind="stable")
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=int(text.max()) + 1)))
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(text.max()).bit_length()))
        # rows that agree in their first `width` symbols, as a bit vector would mark them
        ordered = group[order]
        begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        self.group_begin, self.group_end = begins, np.append(begins[1:], len(text))
        self.group_of_row = ordered
        owner = np.repeat(values, self.lengths + 1)
        self.group_value = np.minimum.reduceat(owner[order], begins)

    def least_values(self) -> list[np.ndarray]:
        """For each string the least value among the strings that hold each of its windows.

        All strings are streamed backwards in step: each takes one symbol to the
        left, and an interval that matches more than `width` symbols is widened
        to those that agree in `width`.
        """
        windows = self.lengths - self.width + 1
        offset = np.cumsum(windows) - windows
        out = np.zeros(int(windows.sum()), np.int64)
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.text), np.int64)
        for step in range(int(self.lengths.max())):
            live = np.flatnonzero(self.lengths > step)
            place = self.lengths[live] - 1 - step
            symbol = self.text[self.starts[live] + place]
            a, b = self.bwt.ranks(symbol, lo[live], hi[live])
            a, b = self.first[symbol] + a, self.first[symbol] + b
            if step >= self.width - 1:
                group = self.group_of_row[a]
                a, b = self.group_begin[group], self.group_end[group]
                out[offset[live] + place] = self.group_value[group]
            lo[live], hi[live] = a, b
        return np.split(out, offset[1:])
