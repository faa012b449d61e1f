"""Words of whole texts as 64-bit hashes: lower-case A-Z, signs at the edges of a word taken off."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from mergestone.llm import word_table as W
from mergestone.llm.word_table import mixed

EDGE = np.zeros(256, bool)
EDGE[list(b".,;:!?\"'()[]{}<>*_`")] = True


def bare(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without signs at their edges; a span of signs alone stays as it is."""
    lo, hi = begin.copy(), end.copy()
    for at, step in ((lo, 1), (hi, -1)):
        some = np.arange(len(at))
        for _ in range(W.SIDE_BY_SIDE):
            some = some[EDGE[raw[at[some] if step > 0 else at[some] - 1]]]
            if not len(some):
                break
            at[some] += step
            some = some[lo[some] < hi[some]]
        for i in some.tolist():  # a long run of signs
            left = raw[lo[i] : hi[i]]
            rest = np.flatnonzero(~EDGE[left])
            at[i] += step * int(len(left) if not len(rest) else rest[0] if step > 0 else len(left) - 1 - rest[-1])
    empty = lo >= hi
    lo[empty], hi[empty] = begin[empty], end[empty]
    return lo, hi


def hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, the number of the first word of each text and of all words)."""
    raw, start = W.bytes_of(column)
    raw = W.LOWER[raw]
    begin, end, first = W.spans(raw, start)
    return W.keys(raw, *bare(raw, begin, end)), first


def hashes_of(text: str | None) -> np.ndarray:
    return hashes(pa.array([text], pa.string()))[0]


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of fewer words, of the whole sequence; of none, nothing."""
    n = min(n, len(h))
    if not n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return mixed(out)
