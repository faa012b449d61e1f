"""Similarity joins of names: pairs of token-sorted keys whose score, 200 LCS / (n + m), reaches a threshold.

Keys of n and m letters with a score of S per cent have a common subsequence of L >= S (n + m) / 200 letters. Two keys with such a score may
share no run of letters that few others hold, so an index does not spare many pairs: all keys of a block may meet. A block is dealt into
numbered parts of about :data:`PART` keys at most, and two parts that meet are a cell, which is one group of a shuffle; small blocks share cells. So a
task holds two parts, however large a block is, and no pair is a row before its score is sure. In a cell, by arrays:

* A pair is a candidate if its lengths allow L and the keys have L letters in common, counted in 128 bits of each key: in the 64 that tell
  most keys apart first, since those alone leave 1 in some 900 pairs of headlines, and in all of them for what is left.
* L of the candidates is found a letter at a time for many pairs at once, the rows of the table of common subsequences being bits of
  integers. In a common subsequence of L letters, letters that meet stand at most n - L places later in the one key, or m - L in the
  other, so others don't count, and a pair is given up when more than m - L letters have met none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.functions.text import _common

#: Keys in a numbered part of a block, on average at most.
PART = 16_384
#: Pairs that the first word of bits lets pass, which meet the second word together.
LOT = 131_072
#: Candidates whose scores are found together, and words of memory for the places of their letters.
PAIRS, WORDS = 16_384, 1 << 21
#: Pairs of a block that are scored one by one, since arrays would cost more.
FEW = 50
#: Scores are compared after rounding to six decimals.
EPS = 1e-6

FOUND = pa.schema([("block", pa.string()), ("a", pa.string()), ("b", pa.string()), ("common", pa.int32())])
ONES = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


def needed(letters: np.ndarray, least: float) -> np.ndarray:
    """The least number of letters in common of two keys with so many letters together."""
    return np.maximum(np.ceil(letters * ((least - EPS) / 200) - EPS), 0).astype(np.int64)


class Side:
    """Keys of one side, shortest first: lengths ``n``, and ``letters`` one after the other, each key's from ``at`` on, with one that stands for the end."""

    def __init__(self, keys: list[str]):
        self.keys = sorted(keys, key=len)
        self.n = np.fromiter(map(len, self.keys), np.int64, len(self.keys))
        self.at = np.cumsum(self.n + 1) - self.n - 1
        self.letters = np.frombuffer("".join(k + "\0" for k in self.keys).encode("utf-32-le"), np.uint32)
        self.ends = self.at + self.n

    def number(self, known: np.ndarray, often: np.ndarray) -> None:
        """Numbers for letters, by how often they stand; one more stands for the end, and for what is not known."""
        by = np.empty(len(known) + 1, np.int64)
        by[np.append(np.argsort(-often, kind="stable"), len(known))] = np.arange(len(known) + 1)
        of = np.full(max(known.max(initial=0), self.letters.max()) + 1, len(known))
        of[known] = by[:-1]
        self.letters = of[self.letters]
        self.letters[self.ends] = len(known)

    def counts(self, many: int) -> np.ndarray:
        """How often each of the first letters stands in each key, up to 40 times."""
        of = np.repeat(np.arange(len(self.n)), self.n + 1)
        few = self.letters < many
        counts = np.bincount(self.letters[few] * len(self.n) + of[few], minlength=len(self.n) * many)
        return np.minimum(counts, 40).astype(np.uint8).reshape(many, len(self.n))


def letter_bits(sides: list[Side], many: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Two words of bits of each key, one for each of up to 128 statements "it holds this letter so many times", of which those are taken that
    tell most keys apart, and how many of its letters they don't count."""
    counts = [s.counts(many) for s in sides]
    total = sum(len(s.n) for s in sides)
    told = []
    for g in range(many):
        held = sum(np.bincount(c[g], minlength=41) for c in counts)
        share = held[::-1].cumsum()[::-1] / total
        told += [(-f * (1 - f), g, k) for k, f in enumerate(share) if 1 <= k < 40 and f > 0]
    told = sorted(told)[:128]
    out = []
    for s, c in zip(sides, counts):
        words = np.zeros((2, len(s.n)), np.uint64)
        for x, (_, g, k) in enumerate(told):
            words[x // 64] |= (c[g] >= k).astype(np.uint64) << np.uint64(x % 64)
        out.append((words[0], words[1], s.n - np.bitwise_count(words[0]) - np.bitwise_count(words[1])))
    return out


def scored(x: Side, y: Side, i: np.ndarray, j: np.ndarray, end: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates (i, j), the rows of i ascending, those that score enough, and how many letters they have in common."""
    rows, row_of = np.unique(i, return_inverse=True)
    n = x.n[rows]
    words = max(1, int(n.max() + 63) // 64)
    own = np.repeat(np.arange(len(rows)), n)
    place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    places = np.zeros((words, len(rows) * (end + 1)), np.uint64)
    np.bitwise_or.at(places, (place >> 6, own * (end + 1) + x.letters[x.at[rows][own] + place]), np.uint64(1) << (place & 63).astype(np.uint64))
    base, m = row_of * (end + 1), y.n[j]
    need = needed(x.n[i] + m, least)
    before, after, at = m - need, x.n[i] - need, y.at[j]
    row = np.full((words, len(i)), ~np.uint64(0))
    alive = np.arange(len(i))
    for t in range(int(m.max(initial=0))):
        if t % 4 == 0:
            go = np.minimum(t, m) - np.bitwise_count(~row).sum(axis=0, dtype=np.int64) <= before
            if not go.all():
                alive, base, m, before, after, at, row = alive[go], base[go], m[go], before[go], after[go], at[go], row[:, go]
            if not len(alive):
                break
            if words == 1:
                near = ONES[np.minimum(t + 4 + after, 64)] & ~ONES[np.clip(t - before, 0, 64)]
        where = base + y.letters[at + np.minimum(t, m)]
        if words == 1:
            hit = row[0] & near & places[0][where]
            row[0] = (row[0] + hit) | (row[0] - hit)
        else:
            carry = np.zeros(len(alive), np.uint64)
            for w in range(words):
                hit = row[w] & places[w][where]
                first = row[w] + hit
                up = first + carry
                carry = ((first < hit) | (up < first)).astype(np.uint64)
                row[w] = up | (row[w] - hit)
    common = np.bitwise_count(~row).sum(axis=0, dtype=np.int64)
    enough = common >= need[alive]
    return i[alive[enough]], j[alive[enough]], common[enough]


def meeting(a: list[str], b: list[str] | None, least: float) -> Iterator[tuple[Sequence[str], Sequence[str], Sequence[int]]]:
    """Pairs of keys of the two lists, or without ``b`` the pairs of the first one, each once and with itself, and their letters in common."""
    if len(a) * len(b or a) <= FEW:
        few = [(p, q, _common(p, q)) for k, p in enumerate(a) for q in (a[k:] if b is None else b)]
        if few := [(p, q, c) for p, q, c in few if c >= needed(len(p) + len(q), least)]:
            yield tuple(zip(*few))
        return
    x = Side(a)
    y = x if b is None else Side(b)
    sides = [x] if b is None else [x, y]
    letters, often = np.unique(np.delete(x.letters, x.ends), return_counts=True)
    for s in sides:
        s.number(letters, often)
    bits = letter_bits(sides, min(len(letters), 64))
    (x0, x1, x2), (y0, y1, y2) = bits[0], bits[-1]
    x_rest, y_rest = x.n - np.bitwise_count(x0), y.n - np.bitwise_count(y0)
    kind, wide = (np.uint8, np.int16) if max(x.n[-1], y.n[-1]) < 256 else (np.int64, np.int64)
    x_rest, y_rest = x_rest.astype(wide), y_rest.astype(wide)
    both, told = np.empty(len(y.n), np.uint64), np.empty(len(y.n), np.uint8)
    waiting: list[tuple[int, np.ndarray]] = []
    pairs = 0

    def ready() -> Iterator[tuple[list[str], list[str], np.ndarray]]:
        i, j = np.repeat([k for k, _ in waiting], [len(j) for _, j in waiting]), np.concatenate([j for _, j in waiting])
        go = np.bitwise_count(x0[i] & y0[j]) + np.bitwise_count(x1[i] & y1[j]) >= needed(x.n[i] + y.n[j], least) - np.minimum(x2[i], y2[j])
        i, j = i[go], j[go]
        if not len(i):
            return
        size = (len(letters) + 1) * (x.n[i[-1]] // 64 + 1)  # keys come by length, so the last is the longest
        rows = np.cumsum(np.diff(i, prepend=-1) != 0)
        lots = np.flatnonzero(np.diff(rows * size // WORDS) | np.diff(np.arange(len(i)) // PAIRS)) + 1
        for p, q in zip(np.split(i, lots), np.split(j, lots)):
            p, q, common = scored(x, y, p, q, len(letters), least)
            yield [x.keys[k] for k in p], [y.keys[k] for k in q], common

    length = -1
    for k, n in enumerate(x.n):
        if n != length:  # the keys that are not too short or too long for this length stand side by side
            length, need = n, needed(n + y.n, least)
            fit = np.flatnonzero(np.minimum(n, y.n) >= need)
            lo, hi = (fit[0], fit[-1] + 1) if len(fit) else (0, 0)
            need, told_least = need.astype(wide), {}
        start = max(lo, k) if b is None else lo
        if start >= hi:
            continue
        rest = x_rest[k]
        if rest not in told_least:
            told_least[rest] = np.maximum(need - np.minimum(y_rest, rest), 0).astype(kind)
        s = slice(start, hi)
        t, u = told[s], both[s]
        np.bitwise_count(np.bitwise_and(y0[s], x0[k], out=u), out=t)
        j = (t >= told_least[rest][s]).nonzero()[0] + start
        if len(j):
            waiting.append((k, j))
            pairs += len(j)
            if pairs >= LOT:
                yield from ready()
                waiting, pairs = [], 0
    if waiting:
        yield from ready()


def similar(left: DataFrame, right: DataFrame, least: float, once: bool = False) -> DataFrame:
    """ER2, JOI11, STR3: (block, a, b, score) of all pairs of distinct token-sorted keys a of ``left`` (block, a) and b of ``right`` (block,
    b) with a score of at least ``least``. With ``once``, for two sides that are the same, pairs come once, with a <= b. Null keys and
    blocks match nothing; two empty keys are equal."""
    keys = lambda df, c: df.select("block", F.col(c).alias("s")).filter("block is not null and s is not null").distinct()
    both = keys(left, "a").withColumn("right", F.lit(False)).unionByName(keys(right, "b").withColumn("right", F.lit(True)))
    parts = lambda c: F.ceil(F.count_if(c) / PART).cast("int")
    # blocks of several parts are few, since each holds more than a part
    large = both.groupBy("block").agg(parts(~F.col("right")).alias("n_a"), parts(F.col("right")).alias("n_b")).filter("greatest(n_a, n_b) > 1")
    shelves = both.agg(F.ceil(F.count("*") / PART)).scalar()
    n = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    dealt = both.join(F.broadcast(large), "block", "left").withColumn("part", F.pmod(F.xxhash64("s"), F.when(F.col("right"), n("n_b")).otherwise(n("n_a"))).cast("int"))
    shelf = F.when(F.col("n_a").isNull(), F.pmod(F.xxhash64("block"), F.greatest(shelves, F.lit(1)))).otherwise(F.xxhash64("block"))
    met = dealt.withColumn("shelf", shelf).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("right"), n("n_a")).otherwise(n("n_b")) - 1)))
    if once:  # a part meets itself and later ones
        met = met.filter(F.when(F.col("right"), F.col("other") < F.col("part")).otherwise(F.col("part") <= F.col("other")))
    cells = met.select("shelf", F.when(F.col("right"), F.col("other")).otherwise(F.col("part")).alias("i"), F.when(F.col("right"), F.col("part")).otherwise(F.col("other")).alias("j"), "block", "s", "right")

    def cell(at: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = once and at[1].as_py() == at[2].as_py()
        held: dict[str, tuple[list[str], list[str]]] = {}
        for r in rows:
            if pc.count_distinct(r.column("block")).as_py() == 1:  # so in every cell of a large block
                right = r.column("right")
                for side, of in enumerate((pc.invert(right), right)):
                    held.setdefault(r.column("block")[0].as_py(), ([], []))[side].extend(r.column("s").filter(of).to_pylist())
                continue
            for block, s, side in zip(*(r.column(c).to_pylist() for c in ("block", "s", "right"))):
                held.setdefault(block, ([], []))[side].append(s)
        for block, (a, b) in held.items():
            if a and (b or alone):
                for x, y, common in meeting(a, None if alone else b, least):
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(x), pa.string()), pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(common, pa.int32())], schema=FOUND)

    # cells are many letters' work for few bytes, so there are many tasks a core however small the rows are, and none that many cells fall to
    tasks = 16 * both.sparkSession.sparkContext.defaultParallelism
    found = cells.repartition(tasks, "shelf", "i", "j").groupBy("shelf", "i", "j").applyInArrow(cell, "block string, a string, b string, common int")
    if once:
        found = found.select("block", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common")
    letters = F.length("a") + F.length("b")
    score = F.when(letters == 0, 100.0).otherwise(F.lit(200.0) * F.col("common") / letters)
    return found.select("block", "a", "b", F.round(score, 6).alias("score")).filter(F.col("score") >= least)
