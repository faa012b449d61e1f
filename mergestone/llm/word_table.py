"""Words of many texts at once, as spans of one array of bytes, and a table that numbers them.

A word is looked up by a 64-bit key of its bytes. Words of up to eight bytes of one length have keys of their own; others are
told apart but for a chance of 2**-64 a pair, as with all hashes of this package.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that end a word: \x20 and \x09-\x0D.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Bytes of a word that are hashed side by side with other words; longer words are hashed one by one.
SIDE_BY_SIDE = 64
MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, start) of a column of strings: the texts end to end, eight bytes of nothing behind them, and where each text
    starts, and where the last one ends. A null is an empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    start = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    n = int(start[-1] - start[0])
    raw = np.zeros(n + 8, np.uint8)
    if n:
        raw[:n] = np.frombuffer(data, np.uint8)[start[0] : start[-1]]
    return raw, start - start[0]


def pieces_of(column: pa.Array, size: int = 2_000_000):
    """(first, end) of runs of rows of about ``size`` bytes; a longer text is a run by itself."""
    column = column.cast(pa.large_binary())
    start = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def spans(raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first): the words of texts, in order, and the number of the first word of each text, and of all words."""
    n = int(start[-1])
    inside = np.empty(n + 2, bool)  # with white space before and behind
    inside[0] = inside[-1] = False
    np.logical_not(WHITE[raw[:n]], out=inside[1:-1])
    edge = inside[1:] != inside[:-1]
    # a text that begins in a word right after another's last word is an edge of both
    cut = start[1:-1]
    cut = np.unique(cut[inside[cut] & inside[cut + 1]])
    at = np.flatnonzero(edge)
    begin, end = at[0::2], at[1::2]
    if len(cut):
        begin, end = np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([end, cut]))
    return begin, end, np.searchsorted(begin, start)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit; different inputs have different outputs."""
    h = h ^ (h >> np.uint64(31))
    h *= MIX
    h ^= h >> np.uint64(29)
    h *= ODD
    h ^= h >> np.uint64(32)
    return h


def keys(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key of each span's bytes, never zero. ``raw`` has eight bytes behind the last span."""
    eight = np.ndarray((max(0, len(raw) - 7),), "<u8", raw.data, strides=(1,))
    size = end - begin
    h = eight[begin] & MASKS[np.minimum(size, 8)]
    h ^= size.astype(np.uint64) * ODD
    h = mixed(h)
    at, some = 8, np.flatnonzero(size > 8)
    while len(some) and at < SIDE_BY_SIDE:
        left = size[some] - at
        h[some] = mixed((h[some] ^ (eight[begin[some] + at] & MASKS[np.minimum(left, 8)])) * ODD + np.uint64(at))
        at += 8
        some = some[left > 8]
    for i in some.tolist():
        h[i] = xxhash.xxh64_intdigest(raw[begin[i] : end[i]].tobytes(), 11)
    h[h == 0] = 1
    return h


class Numbers:
    """Keys -> numbers 0, 1, ... in the order in which they came; open addressing in arrays."""

    def __init__(self):
        self.clear()

    def __len__(self) -> int:
        return self.n

    def clear(self) -> None:
        self.n = 0
        self.slots, self.number = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Number of each key, or -1."""
        mask = np.uint64(len(self.slots) - 1)
        at = (key & mask).astype(np.int64)
        held = self.slots[at]
        out = self.number[at]
        out[held == 0] = -1
        some = np.flatnonzero((held != key) & (held != 0))
        own, at = key[some], at[some]
        while len(some):
            at = (at + 1) & int(mask)
            held = self.slots[at]
            hit = held == own
            out[some[hit]] = self.number[at[hit]]
            out[some[held == 0]] = -1
            on = ~hit & (held != 0)
            some, own, at = some[on], own[on], at[on]
        return out

    def add(self, key: np.ndarray) -> None:
        """New keys, each once."""
        while (self.n + len(key)) * 2 > len(self.slots):
            old, number = self.slots, self.number
            self.slots, self.number = np.zeros(2 * len(old), np.uint64), np.zeros(2 * len(old), np.int32)
            had = np.flatnonzero(old)
            self._put(old[had], number[had])
        self._put(key, np.arange(self.n, self.n + len(key), dtype=np.int32))
        self.n += len(key)

    def _put(self, key: np.ndarray, number: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (key & np.uint64(mask)).astype(np.int64)
        while len(key):
            free = self.slots[at] == 0
            self.slots[at[free]] = key[free]  # of several keys for a slot the last one stays
            mine = self.slots[at] == key
            self.number[at[mine]] = number[mine]
            key, number, at = key[~mine], number[~mine], (at[~mine] + 1) & mask

    def found(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each key, places of the first of each key that was new); new keys are added in order of their places."""
        out = self.find(key)
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out, new
        own, first, back = np.unique(key[new], return_index=True, return_inverse=True)
        order = np.argsort(first, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        out[new] = self.n + rank[back]
        self.add(own[order])
        return out, new[first[order]]


class Runs:
    """Runs of values of any length, numbered in the order in which they came, in arrays that grow."""

    def __init__(self, kind):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.flat, self.start = np.zeros(1 << 12, self.kind), np.zeros(1 << 12, np.int64)

    def add(self, values: np.ndarray, size: np.ndarray) -> None:
        """Runs of these sizes, end to end."""
        m, at = self.n + len(size), int(self.start[self.n])
        if m + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(m, np.int64)])
        self.start[self.n + 1 : m + 1] = at + np.cumsum(size)
        if at + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat[:at], np.zeros(at + 2 * len(values), self.kind)])
        self.flat[at : at + len(values)] = values
        self.n = m

    def take(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, end): the runs of these numbers end to end, and where each ends."""
        lo = self.start[number]
        n = self.start[number + 1] - lo
        end = np.cumsum(n)
        at = np.repeat(lo - (end - n), n)
        at += np.arange(len(at))
        return self.flat[at], end


def ends_of(end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where each text ends, of the ends of its words and the numbers of first words."""
    return np.concatenate([np.zeros(1, np.int64), end])[first[1:]]


def cut_out(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes) of spans, end to end."""
    size = end - begin
    past = np.cumsum(size)
    at = np.repeat(begin - (past - size), size)
    at += np.arange(len(at))
    return raw[at], size


def binaries(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """An Arrow column of byte strings of these sizes."""
    start = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=start[1:])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(start), pa.py_buffer(np.ascontiguousarray(data))])
