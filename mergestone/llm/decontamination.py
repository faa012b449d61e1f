"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact weighted-shingle similarity.

Items are grouped by size class c (the largest step of :data:`SIZES` not above their word count). The first and the last c
words of an item each get a 64-bit SimHash of their word pairs, and so does every window of c words at every position of every
text, from running sums of the bits, so a window costs the same whatever its size; a text of fewer than c words is one window.
A table for each 16-bit block tells the fewest bits in which a value differs from an item's: the sum over the four blocks is
never above the distance to the nearest item, so no fingerprint within :data:`RADIUS` is lost. Windows that pass are compared
in full, and where the distance is within the radius the aligned stretch of the item's length is compared exactly: weighted
Jaccard similarity of word shingles, a shingle weighing one over the number of items that hold it.

Similarity needs a shingle in common, so only texts and stretches that hold some shingle of an item are compared at all.

Items are held by every task up to ``bound`` characters of them; a larger benchmark is taken in that many slices, each a pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.llm import word_table as W
from mergestone.llm.word_hashes import hashes, hashes_of, mixed, runs

SIZES = tuple(sorted({*range(1, 8), *(int(8 * 1.35**k) for k in range(30))}))
STEP = 8192
#: Differing bits up to which windows are compared exactly.
RADIUS = 17
#: Items' windows that share block tables, and tables that a class has at most.
SHARE, MOST = 32, 8
LOW = np.uint64((1 << 20) - 1)


def pair_bits(h: np.ndarray, c: int) -> np.ndarray:
    """(pairs, 64) bits of the word pairs; for windows of one word, of the words."""
    f = mixed(h) if c == 1 else mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def running(bits: np.ndarray) -> np.ndarray:
    """Running sums that begin with a row of zeros."""
    kind = np.int16 if len(bits) < 1 << 15 else np.int32
    total = np.zeros((len(bits) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=total[1:])
    return total


def window_prints(total: np.ndarray, n: int) -> np.ndarray:
    """SimHash of all windows of ``n`` features, from running sums that begin with a row of zeros."""
    return np.packbits((total[n:] - total[:-n]) > n // 2, axis=1, bitorder="little").view(np.uint64).ravel()


def block_tables(f: np.ndarray) -> np.ndarray:
    """(4, 65536) fewest bits in which a block of that value differs from the same block of a fingerprint of ``f``."""
    out = np.full((4, 1 << 16), 16, np.uint8)
    out[np.arange(4), f.view("<u2").reshape(-1, 4)] = 0
    for b in range(16):  # one bit after another may be flipped or not
        pair = out.reshape(4, -1, 2, 1 << b)
        np.minimum(pair, pair[:, :, ::-1] + np.uint8(1), out=pair)
    return out


def shingle_weights(h: np.ndarray, n: int) -> Counter:
    return Counter(runs(h, n).tolist())


class Items:
    def __init__(self, items: list[tuple[int, str]], n: int = 5, least: float = 0.8, radius: int = RADIUS):
        self.n, self.least, self.radius = n, least, radius
        self.items = [(i, h) for i, t in items if len(h := hashes_of(t))]
        self.shingles = [shingle_weights(h, n) for _, h in self.items]
        held = Counter(s for c in self.shingles for s in c)
        self.weight = {s: 1 / k for s, k in held.items()}
        #: lengths of shingles in words, their hashes, and a table of the low bits of those
        self.lengths = sorted({min(n, len(h)) for _, h in self.items})
        self.known = np.array(sorted(self.weight), np.uint64)
        self.weights = np.array([self.weight[s] for s in self.known.tolist()])
        #: of each item: its shingles in order, how often it has each, and their weight in sum
        self.own = [(np.array(sorted(c), np.uint64), np.array([c[s] for s in sorted(c)]), sum(self.weight[s] * k for s, k in c.items())) for c in self.shingles]
        self.marks = np.zeros(1 << 20, bool)
        self.marks[self.known & LOW] = True
        #: class -> fingerprints, (item, words from its start to the window), (number of the first, tables) of each share
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]] = {}
        by: dict[int, list[tuple[np.uint64, int, int]]] = {}
        for k, (_, h) in enumerate(self.items):
            c = max(s for s in SIZES if s <= len(h))
            for at in {0, len(h) - c}:
                by.setdefault(c, []).append((self.prints(h[at : at + c], c)[0], k, at))
        for c, members in by.items():
            f = np.array([m[0] for m in members], np.uint64)
            share = max(SHARE, -(-len(f) // MOST))
            tables = [(k, block_tables(f[k : k + share])) for k in range(0, len(f), share)]
            self.classes[c] = f, np.array([(m[1], m[2]) for m in members]), tables

    def prints(self, h: np.ndarray, c: int) -> np.ndarray:
        bits = pair_bits(h, c)
        return window_prints(running(bits), max(1, c - 1))

    def candidates(self, h: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int, int]]:
        """(item, first word of the aligned stretch, distance) of all windows within ``radius``."""
        out = []
        widest = max(self.classes, default=0)
        for lo in range(0, len(h), STEP):
            part = h[lo : lo + STEP + widest - 1]
            total = None
            for c, (prints, who, tables) in self.classes.items():
                if len(h) < c:
                    f = self.prints(h, len(h))
                elif len(part) < c:
                    continue
                elif c == 1:
                    f = self.prints(part, 1)
                else:
                    if total is None:
                        total = running(pair_bits(part, 2))
                    f = window_prints(total, c - 1)
                f = f[:STEP]
                block = f.view("<u2").reshape(-1, 4)
                share = tables[1][0] if len(tables) > 1 else len(prints)
                for first, (t0, t1, t2, t3) in tables:
                    least = t0[block[:, 0]] + t1[block[:, 1]] + t2[block[:, 2]] + t3[block[:, 3]]
                    some, own = np.flatnonzero(least <= radius), prints[first : first + share]
                    rows = max(1, (1 << 20) // len(own))
                    for k in range(0, len(some), rows):
                        far = np.bitwise_count(f[some[k : k + rows], None] ^ own[None, :])
                        a, b = np.nonzero(far <= radius)
                        out += zip(who[first + b, 0].tolist(), (lo + some[k + a] - who[first + b, 1]).tolist(), far[a, b].tolist())
        return out

    def holding(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of texts end to end, the number of shingles of items that begin before each word, and before the end."""
        out, left = np.zeros(len(h) + 1, np.int64), np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
        for k in self.lengths:
            if len(h) >= k:
                r = runs(h, k)
                some = np.flatnonzero(self.marks[r & LOW] & (left[: len(r)] >= k))
                at = np.searchsorted(self.known, r[some])
                out[some[self.known[np.minimum(at, len(self.known) - 1)] == r[some]] + 1] += 1
        return np.cumsum(out)

    def similarity(self, item: int, h: np.ndarray) -> float:
        own, other = self.shingles[item], shingle_weights(h, self.n)
        both = one = 0.0
        for s in own.keys() | other.keys():
            w = self.weight.get(s, 1.0)
            both += w * min(own[s], other[s])
            one += w * max(own[s], other[s])
        return both / one if one else 0.0

    def similarities(self, item: int, h: np.ndarray, a0: int, a1: int) -> np.ndarray:
        """:meth:`similarity` of the stretches of the item's length that begin at a0, a0 + 1, .. a1, as far as the text reaches.

        A shingle at p counts as shared in the stretches from a on that hold it, but for those that hold it more often before
        than the item has it: so p adds its weight to a run of values of a, and running sums give all stretches at once."""
        n = len(self.items[item][1])
        k = min(self.n, n)
        m = n - k + 1  # shingles of a stretch
        p0, p1 = max(0, a0), min(len(h) - k + 1, a1 + m)
        if p1 <= p0:
            return np.zeros(a1 - a0 + 1)
        r, p = runs(h[p0 : p1 + k - 1], k), np.arange(p0, p1)
        at = np.minimum(np.searchsorted(self.known, r), len(self.known) - 1)
        w = np.where(self.known[at] == r, self.weights[at], 1.0)
        values, often, sum_own = self.own[item]
        at = np.minimum(np.searchsorted(values, r), len(values) - 1)
        order = np.flatnonzero(values[at] == r)
        order = order[np.argsort(at[order], kind="stable")]
        which, place = at[order], np.arange(len(order))
        back = place - often[which]  # the occurrence that many before
        same = (back >= 0) & (which[np.maximum(back, 0)] == which)
        begin = np.maximum(np.where(same, p[order[np.maximum(back, 0)]], -(1 << 60)) + 1, np.maximum(p[order] - m + 1, a0))
        end = np.minimum(p[order], a1)
        some = begin <= end
        change = np.bincount(begin[some] - a0, w[order[some]], a1 - a0 + 2) - np.bincount(end[some] + 1 - a0, w[order[some]], a1 - a0 + 2)
        both = np.cumsum(change)[:-1]
        total, a = np.append(0, np.cumsum(w)), np.arange(a0, a1 + 1)
        other = total[np.clip(a + m - p0, 0, len(w))] - total[np.clip(a - p0, 0, len(w))]
        return both / (sum_own + other - both)

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, best similarity, first word of the best stretch, stretches that don't overlap) of all items that the text holds."""
        return self.matches_of(pa.array([text], pa.string()))[0]

    def matches_of(self, column: pa.Array) -> list[list[tuple[int, float, int, int]]]:
        """:meth:`matches` of many texts; only those that hold a shingle of an item are looked into."""
        h, first = hashes(column)
        begun = self.holding(h, first)
        held = begun[first[1:]] > begun[first[:-1]]
        out: list[list] = [[] for _ in held]
        for d in np.flatnonzero(held | (self.least <= 0)).tolist():
            out[d] = self.found(h[first[d] : first[d + 1]], begun[first[d] : first[d + 1] + 1])
        return out

    def found(self, h: np.ndarray, begun: np.ndarray) -> list[tuple[int, float, int, int]]:
        near = np.array(self.candidates(h, self.radius), np.int64).reshape(-1, 3)
        out = []
        for item in np.unique(near[:, 0]).tolist():
            n = len(self.items[item][1])
            start = np.unique(near[near[:, 0] == item, 1])
            if self.least > 0:
                start = start[begun[np.clip(start + n, 0, len(h))] > begun[np.maximum(start, 0)]]
            good, share = [start[:0]], [np.zeros(0)]
            for run in np.split(start, np.flatnonzero(np.diff(start) > n) + 1) if len(start) else []:  # neighbours together
                s = self.similarities(item, h, int(run[0]), int(run[-1]))[run - run[0]]
                good.append(run[s > self.least - 1e-9])
                share.append(s[s > self.least - 1e-9])
            good, share = np.maximum(np.concatenate(good), 0), np.concatenate(share)
            if not len(good):
                continue
            end, count = -1, 0
            for lo in good.tolist():  # stretches that overlap are one
                if lo >= end:
                    count, end = count + 1, lo + n
            at = int(np.flatnonzero(share >= share.max() - 1e-9)[0])
            out.append((item, min(1.0, round(float(share[at]), 12)), int(good[at]), count))
        return [(self.items[i][0], *x) for i, *x in out]


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, least: float = 0.8, radius: int = RADIUS, bound: int = 16_000_000) -> DataFrame:
    """One row (doc_id, item_id, similarity, first_word, n_windows) for each document and item that it holds.

    Null or empty texts and items hold and match nothing; items of fewer than ``n`` words have one shingle. Items with equal
    texts match alike. Repeated rows give repeated results; a null doc_id stays null; extra columns are not read; with an
    empty table the result is empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for held in slices_of(benchmark, bound):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Items(held, n, least, radius)
            for batch in batches:
                for lo, hi in W.pieces_of(batch.column(1)):
                    part = batch.slice(lo, hi - lo)
                    found = [(d, *m) for d, own in zip(part.column(0).to_pylist(), index.matches_of(part.column(1))) for m in own]
                    cols = list(zip(*found)) if found else [[]] * 5
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "similarity", "first_word", "n_windows"])

        one = rows.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_windows long")
        out = one if out is None else out.unionByName(one)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, least: float = 0.8, radius: int = RADIUS, bound: int = 16_000_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item. Rows with a null or empty text, or a null doc_id, are
    judged by their text alone, so the former stay; other cases as in :func:`contaminated`."""
    at = docs.columns.index("text")
    for held in slices_of(benchmark, bound):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Items(held, n, least, radius)
            for batch in batches:
                for lo, hi in W.pieces_of(batch.column(at)):
                    part = batch.slice(lo, hi - lo)
                    yield part.filter(pa.array([not own for own in index.matches_of(part.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def slices_of(benchmark: DataFrame, bound: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of about ``bound`` characters at most, each of which every task can hold."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // bound))
    for k in range(slices):
        own = items if slices == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        yield [(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()]
