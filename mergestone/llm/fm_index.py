"""A full-text index in compressed form: the Burrows-Wheeler transform of numbers in a wavelet matrix of packed bits, searched backwards.

Suffixes are put in order by their first ``depth`` symbols only, by prefix doubling. That suffices for matches of up to ``depth``
symbols: the rows whose suffixes begin with a pattern are neighbours, and a backward step needs to know how many rows before them begin
with less, which their first symbols decide. Searches go side by side for many places of a stream.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of the first ``depth`` symbols, or some more, that begin there."""
    rank, step = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        behind = np.zeros(len(rank), np.int64)
        behind[: len(rank) - step] = rank[step:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + behind
        order = np.argsort(key, kind="stable")
        own = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])]) if len(own) else own
        step *= 2
    return order


class WaveletMatrix:
    """Numbers by their bits, the highest first; each level has its ones counted by blocks of 64."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for k in reversed(range(self.bits)):
            one = values >> k & 1 == 1
            packed = np.packbits(one, bitorder="little")
            block = np.zeros(len(values) // 64 + 1, np.uint64)
            block.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(block), np.int64)
            np.cumsum(np.bitwise_count(block[:-1]), out=before[1:])
            values = np.concatenate([values[~one], values[one]])
            self.levels.append((block, before, len(values) - int(one.sum())))

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` is on the lowest level on the way of ``symbol``: the symbol's count before ``at`` is this less that of 0."""
        for k, (block, before, zeros) in zip(reversed(range(self.bits)), self.levels):
            at = at.astype(np.int64)
            slot = at >> 6
            ones = before[slot] + np.bitwise_count(block[slot] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> k & 1 == 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Index of ``text``, numbers from 0 to ``symbols`` - 1, for matches of up to ``depth``; 0 is a separator that no search meets, and
    the text's last symbol."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        self.depth, self.symbols = depth, symbols
        #: The place in the text of each row.
        self.place = suffix_order(text, depth)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.matrix = WaveletMatrix(text[self.place - 1], symbols)
        every = np.arange(symbols)
        self.base = self.matrix.down(every, np.zeros(symbols, np.int64))

    def matching_statistics(self, stream: np.ndarray, last: np.ndarray, most: int, alone: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place ``last`` of a stream: the length, at most ``most``, of the longest match that ends there, and its rows lo to
        hi. Separators and symbols outside the index (below 1, or ``symbols`` and above) match nothing. With ``alone`` a search ends
        where one row is left, as of places that are in the index themselves."""
        length, low, high = np.zeros(len(last), np.int64), np.zeros(len(last), np.int64), np.zeros(len(last), np.int64)
        some, lo, hi = np.arange(len(last)), np.zeros(len(last), np.int64), np.full(len(last), len(self.place))
        for k in range(min(most, self.depth)):
            at = last[some] - k
            symbol = np.where(at >= 0, stream[np.maximum(at, 0)], 0)
            known = (symbol > 0) & (symbol < self.symbols)
            some, lo, hi, symbol = some[known], lo[known], hi[known], symbol[known]
            if k:
                shift = self.less[symbol] - self.base[symbol]
                both = self.matrix.down(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
                lo, hi = both[: len(lo)] + shift, both[len(lo) :] + shift
            else:
                lo, hi = self.less[symbol], self.less[symbol + 1]
            found = lo < hi
            some, lo, hi = some[found], lo[found], hi[found]
            length[some], low[some], high[some] = k + 1, lo, hi
            if alone:
                more = hi - lo > 1
                some, lo, hi = some[more], lo[more], hi[more]
            if not len(some):
                break
        return length, low, high


def least_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least value of rows lo to hi, of ranges that are equal or apart."""
    if not len(lo):
        return np.zeros(0, values.dtype)
    start, first, back = np.unique(lo, return_index=True, return_inverse=True)
    ends = np.stack([start, hi[first]], axis=1).ravel()
    return np.minimum.reduceat(np.append(values, values[-1:]), ends)[::2][back]
