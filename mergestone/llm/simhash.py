"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are compared as vertical bit planes: plane k holds bit k of 64 fingerprints in each machine word, so one
``xor`` compares 64 pairs at a bit and carry-save counters add the outcome to 64 distances at once. A block of lanes is
abandoned as soon as every distance in it exceeds the radius.

Which fingerprints are compared at all is dealt out by Spark: each fingerprint goes to a bucket for every key, a key
being the values of a few of its blocks. For :func:`hamming_links` the blocks are chosen so that any two fingerprints
within the radius agree on all blocks of at least one key (pigeonhole), so no link is lost. A bucket above ``chunk``
members is split into chunks, and every pair of chunks is a task of its own.

Nulls, empty texts, ties: see :func:`fingerprints` and :func:`simhash_classes`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.llm.shared import components, looked_up, written
from mergestone.llm.word_table import mixed

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
KEY_SEED = 0x5BD1E995


def words(text: str | None) -> list[bytes]:
    """Lower-case A-Z, then the runs of bytes other than space and \\x09-\\x0D, which is what ``bytes.split`` cuts at."""
    return text.encode().translate(LOWER).split() if text else []


def shingles(tokens: list[bytes], n: int) -> list[bytes]:
    """All runs of ``n`` tokens, repeats included; of fewer tokens, the whole sequence; of none, nothing."""
    if len(tokens) <= n:
        return [b" ".join(tokens)] if tokens else []
    joined = b" ".join(tokens)
    at = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1, out=at[1:])
    at = at.tolist()
    return [joined[i : j - 1] for i, j in zip(at, at[n:])]


def majority(hashes: np.ndarray, bits: int) -> np.ndarray:
    """``hashes``: (n, bits // 64) unsigned words. Bit k of the result is 1 if it is set in over half of the rows."""
    if not len(hashes):
        return np.zeros(bits // 64, np.uint64)
    total = np.zeros(bits, np.int64)
    for i in range(0, len(hashes), 16384):  # whole texts, in blocks of bounded memory
        part = np.unpackbits(np.ascontiguousarray(hashes[i : i + 16384]).view(np.uint8), axis=1, bitorder="little")
        total += part.sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)


def widened(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of 128 bits made ``bits`` wide: each further two words mix all bits of the first two anew."""
    out = [hashes]
    for k in range(1, bits // 128):
        out.append(mixed(hashes + hashes[:, ::-1] * np.uint64(2 * k + 1) + np.uint64(k)))
    return np.hstack(out)


def text_fingerprint(text: str | None, n: int = 4, bits: int = 64) -> np.ndarray:
    """64 bits: XXH64 with seed 42 of every shingle, with repeats. 128 bits: XXH128 of the distinct shingles."""
    parts = shingles(words(text), n)
    if bits == 64:
        h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in parts), np.uint64, len(parts)).reshape(-1, 1)
    else:
        parts = set(parts)
        h = np.frombuffer(b"".join(xxhash.xxh128_digest(s, 42) for s in parts), np.uint64).reshape(-1, 2)
    return majority(h, bits)


def fingerprints(docs: DataFrame, n: int = 4, bits: int = 64) -> DataFrame:
    """One row (doc_id, f0[, f1]) for each row of ``docs``; the words are signed longs with the fingerprint's bits.

    A null or empty text, or one of white space only, has the fingerprint zero. Whole texts are read.
    """
    m = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = np.array([text_fingerprint(t.as_py(), n, bits) for t in part.column(1)], np.uint64).reshape(-1, m)
                cols = [pa.array(np.ascontiguousarray(got[:, k]).view(np.int64)) for k in range(m)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *cols], ["doc_id", *(f"f{k}" for k in range(m))])

    schema = "doc_id long, " + ", ".join(f"f{k} long" for k in range(m))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


# ---------------------------------------------------------------------------------------------- bit-sliced comparison


def planes(f: np.ndarray, bits: int) -> np.ndarray:
    """``f``: (n, bits // 64) unsigned words. (bits, ceil(n / 64)) words: bit i % 64 of word i // 64 is that of row i.

    Squares of 64 by 64 bits are transposed by swapping their quarters, then the quarters of these, and so on."""
    n, m = len(f), bits // 64
    square = np.zeros((-(-n // 64) * 64, m), np.uint64)
    square[:n] = f
    square = np.ascontiguousarray(square.T).reshape(m, -1, 64)
    for k in (32, 16, 8, 4, 2, 1):
        quarters = square.reshape(m, -1, 64 // (2 * k), 2, k)
        low, high = quarters[..., 0, :], quarters[..., 1, :]
        mask = np.uint64(sum(((1 << k) - 1) << i for i in range(0, 64, 2 * k)))
        swap = low >> np.uint64(k)
        swap ^= high
        swap &= mask
        high ^= swap
        low ^= swap << np.uint64(k)
    return np.ascontiguousarray(square.transpose(0, 2, 1)).reshape(bits, -1)


def _save(ones: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Carry-save adder: ``ones`` becomes the sum's low bits; returns the carries, worth two."""
    half = a ^ b
    carry = a & b
    carry |= half & ones
    ones ^= half
    return carry


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count exceeds ``radius``, compared bit by bit from the highest."""
    over, equal = np.zeros_like(counters[0]), np.full_like(counters[0], np.uint64(2**64 - 1))
    if radius >> len(counters):
        return over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            over |= equal & counters[k]
            equal &= ~counters[k]
    return over


def within(left: np.ndarray, right: np.ndarray, radius: int, step: int = 16) -> np.ndarray:
    """``left``, ``right``: planes that broadcast to (bits, ..., words). Packed lanes: is the distance <= radius?

    Eight planes at a time go through a tree of carry-save adders into bit-sliced counters. After every ``step`` planes the words
    in which all 64 distances exceed the radius are dropped from the work, once that is a third of them.
    """
    bits, shape = len(left), np.broadcast_shapes(left.shape[1:], right.shape[1:])
    out = np.zeros(int(np.prod(shape)), np.uint64)
    if not out.size:
        return out.reshape(shape)
    alive = at_left = at_right = None
    counters = [np.zeros(shape, np.uint64) for _ in range(bits.bit_length())]
    everything = np.uint64(2**64 - 1)
    left_flat, right_flat = left.reshape(bits, -1), right.reshape(bits, -1)

    def differing(k: int) -> np.ndarray:
        return left[k] ^ right[k] if alive is None else left_flat[k][at_left] ^ right_flat[k][at_right]

    for k in range(0, bits, 8):
        twos = [_save(counters[0], differing(k + j), differing(k + j + 1)) for j in (0, 2, 4, 6)]
        fours = [_save(counters[1], *twos[:2]), _save(counters[1], *twos[2:])]
        carry = _save(counters[2], *fours)
        for j in range(3, len(counters)):
            more = counters[j] & carry
            counters[j] ^= carry
            carry = more
        if (k + 8) % step == 0 and k + 8 > radius and k + 8 < bits:
            keep = (_over(counters, radius) != everything).ravel()
            if not keep.any():
                return out.reshape(shape)
            if keep.mean() < 0.67:
                if alive is None:
                    alive = np.flatnonzero(keep)
                    at_left = np.broadcast_to(np.arange(left_flat.shape[1]).reshape(left.shape[1:]), shape).ravel()[alive]
                    at_right = np.broadcast_to(np.arange(right_flat.shape[1]).reshape(right.shape[1:]), shape).ravel()[alive]
                else:
                    alive, at_left, at_right = alive[keep], at_left[keep], at_right[keep]
                counters = [c.ravel()[keep] for c in counters]
    out[slice(None) if alive is None else alive] = ~_over(counters, radius).ravel()
    return out.reshape(shape)


def unpacked(lanes: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def spanning(f: np.ndarray, bits: int, radius: int, side: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect all rows of ``f`` connected by distances within the radius; with ``side`` (0 or 1), only
    distances between the two sides count, and with ``known`` rows of equal numbers are of one group from the start.

    Rows are taken in batches and compared with the rows not taken yet. Once many rows of one group wait to be taken,
    they are compared only with rows outside that group, so a dense group costs about its size, not its square.
    """
    n, two = len(f), side is not None
    side = np.zeros(n, np.int8) if side is None else side
    group, done, waiting = np.arange(n), np.zeros(n, bool), np.zeros(n, bool)
    if known is not None:
        group = np.unique(known, return_inverse=True)[1]
        waiting[:] = np.bincount(group)[group] > 1
    found: list[tuple[int, int]] = []
    sliced: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    full = np.uint64(2**64 - 1)
    while True:
        own, one = np.flatnonzero(waiting & ~done), None
        if len(own) >= 32:
            value, count = np.unique(group[own], return_counts=True)
            one = value[count.argmax()] if count.max() >= 32 else None
        if one is None:
            s, use = 0, ~done
            taken = np.flatnonzero(~done & (side == 0))[:256]
        else:
            own = own[group[own] == one]
            s, use = side[own[0]], ~done & (group != one)
            taken = own[side[own] == s][:256]
        if not len(taken):
            return found
        other = 1 - int(s) if two else 0
        use &= side == other
        if one is not None and not use.any():
            done[own[side[own] == s]] = True
            continue
        rows, lanes = sliced.get(other, (None, None))
        if rows is None or use.sum() < 0.7 * len(rows):
            rows = np.flatnonzero(use) if one is None else np.flatnonzero(~done & (side == other) & (group != one))
            lanes = planes(f[rows], bits)
            if one is None:
                sliced[other] = rows, lanes
        q = np.unpackbits(np.ascontiguousarray(f[taken]).view(np.uint8).reshape(len(taken), -1), axis=1, bitorder="little").T
        near = within(np.where(q[:, :, None] == 1, full, np.uint64(0)), lanes[:, None, :], radius)
        some = np.flatnonzero(near.any(axis=1))
        at, hit = np.nonzero(unpacked(near[some], len(rows)))
        new = group[taken[some[at]]] != group[rows[hit]]
        at, hit = some[at[new]], rows[hit[new]]
        for k in np.unique(at).tolist():
            i, own = taken[k], hit[at == k]
            own = own[group[own] != group[i]]
            if len(own):
                value, first = np.unique(group[own], return_index=True)
                found += [(int(i), int(own[x])) for x in first]
                waiting[own] = waiting[i] = True
                group[np.isin(group, value)] = group[i]
        done[taken] = True


def small_links(f: np.ndarray, bucket: np.ndarray, bits: int, radius: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All links inside small buckets, but for rows ``known`` to be of one group. ``bucket``: ascending bucket numbers. Lanes
    are the pairs of many buckets together, of a bounded number of pairs at a time."""
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[start, len(bucket)])
    pairs = np.cumsum(size * (size - 1) // 2)
    out_l, out_r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(pairs, (pairs[lo - 1] if lo else 0) + (1 << 17))))
        rows = np.arange(start[lo], start[hi - 1] + size[hi - 1])
        first = np.repeat(start[lo:hi], size[lo:hi])
        place = rows - first  # each row meets those before it in its bucket
        right = np.repeat(rows, place)
        left = np.arange(len(right)) - np.repeat(np.cumsum(place) - place, place) + np.repeat(first, place)
        lo = hi
        if known is not None:
            new = known[left] != known[right]
            left, right = left[new], right[new]
        if len(left):
            apart = planes(f[left] ^ f[right], bits)
            near = unpacked(within(apart, np.zeros((bits, 1), np.uint64), radius), len(left))
            left, right = left[near], right[near]
        out_l.append(left)
        out_r.append(right)
    return np.concatenate(out_l), np.concatenate(out_r)


# ------------------------------------------------------------------------------------------------------- distribution


def block_keys(bits: int, radius: int, blocks: int) -> list[list[int]]:
    """Bit numbers of each key: ``blocks`` - radius of the blocks, in every choice. Two fingerprints within the radius
    differ in at most ``radius`` blocks, so they agree on all others, and these hold one of the choices."""
    cut = np.linspace(0, bits, blocks + 1).astype(int)
    parts = [list(range(cut[i], cut[i + 1])) for i in range(blocks)]
    return [[b for i in choice for b in parts[i]] for choice in combinations(range(blocks), blocks - radius)]


def drawn_keys(bits: int, width: int, count: int) -> list[list[int]]:
    """``count`` keys of ``width`` bit numbers each, drawn with a fixed seed."""
    rng = np.random.default_rng(KEY_SEED)
    return [sorted(rng.choice(bits, width, replace=False).tolist()) for _ in range(count)]


def draws_for(bits: int, width: int, similarity: float, recall: float) -> int:
    """Draws of ``width`` bits of which two fingerprints share one with a probability of ``recall``, at a Jaccard similarity of
    their sets: a bit, being the sign of a sum over each set, differs with the probability acos(r) / pi, r being the share of
    what the two sets have in common, and the distance is taken as binomial."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    share = [math.comb(bits, d) * p**d * (1 - p) ** (bits - d) for d in range(bits + 1)]
    meet = [math.comb(bits - d, width) / math.comb(bits, width) for d in range(bits + 1)]
    n = 1
    while sum(s * (1 - (1 - m) ** n) for s, m in zip(share, meet)) < recall:
        n += 1
    return n


def linked(prints: DataFrame, keys: list[list[int]], bits: int, radius: int, chunk: int = 8192) -> DataFrame:
    """Links (a, b) between rows (id, f0[, f1]) within the radius that share a bucket of some key; within a bucket only
    as many links as connect its groups, never all pairs.

    Spark deals rows to buckets by (key, its bits). Buckets above ``chunk`` rows are counted first, by an aggregation
    that combines before its shuffle, and split by a hash of the id: each pair of chunks is one group. Rows may carry a
    ``label``: rows of equal labels are known to be of one group, and no links between them are returned.
    """
    m = bits // 64
    cols = [f"f{k}" for k in range(m)]

    def value(key: list[int]):
        # bits are moved together by masks and shifts of runs, so that this stays in generated code
        out, at, i = F.lit(0).cast("long"), 0, 0
        while i < len(key):
            j = i
            while j + 1 < len(key) and key[j + 1] == key[j] + 1 and key[j + 1] // 64 == key[i] // 64:
                j += 1
            run = F.shiftrightunsigned(F.col(cols[key[i] // 64]), key[i] % 64).bitwiseAND(F.lit((1 << (j - i + 1)) - 1).cast("long"))
            out, at, i = out.bitwiseOR(F.shiftleft(run, at)), at + j - i + 1, j + 1
        return out

    if max(map(len, keys)) > 48 or len(keys) > 1 << 15:
        raise ValueError("a key holds more than 48 bits, or there are too many keys")
    numbered = [F.shiftleft(value(key), 15).bitwiseOR(F.lit(i).cast("long")) for i, key in enumerate(keys)]
    labelled = "label" in prints.columns
    if labelled:
        cols.append("label")
    dealt = prints.select("id", *cols, F.explode(F.array(*numbered)).alias("bucket"))
    hot = written(dealt.groupBy("bucket").count().filter(F.col("count") > chunk).select("bucket", F.ceil(F.col("count") / chunk).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        placed = dealt.select("id", *cols, "bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    else:
        placed = dealt.join(hot, "bucket", "left").withColumn("own", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
        meets = F.expr("transform(sequence(0, coalesce(parts, 1) - 1), x -> struct(least(x, own) AS i, greatest(x, own) AS j, int(own > x) AS side))")
        placed = placed.select("id", *cols, "bucket", F.explode(meets).alias("p")).select("id", *cols, "bucket", "p.*")
    row = F.struct("side", "id", *cols)
    groups = placed.groupBy("bucket", "i", "j").agg(F.collect_list(row).alias("rows")).filter(F.size("rows") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            flat = lists.flatten()
            f = np.stack([flat.field(2 + k).to_numpy(zero_copy_only=False) for k in range(m)], axis=1).view(np.uint64)
            label = flat.field(2 + m).to_numpy(zero_copy_only=False) if labelled else None
            ids, side = flat.field(1).to_numpy(zero_copy_only=False), flat.field(0).to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy())
            two = (batch.column("i").to_numpy() != batch.column("j").to_numpy())
            number = np.repeat(np.arange(len(size)), size)
            small = (size <= 128) & ~two
            rows = np.flatnonzero(small[number])
            a, b = small_links(f[rows], number[rows], bits, radius, label[rows] if labelled else None) if len(rows) else (np.zeros(0, int), np.zeros(0, int))
            left, right = [ids[rows[a]]], [ids[rows[b]]]
            start = np.r_[0, np.cumsum(size)]
            for g in np.flatnonzero(~small):
                own = slice(start[g], start[g + 1])
                got = spanning(f[own], bits, radius, side[own] if two[g] else None, label[own] if labelled else None)
                if got:
                    pair = np.array(got)
                    left.append(ids[own][pair[:, 0]])
                    right.append(ids[own][pair[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return groups.select("i", "j", "rows").mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_classes(docs: DataFrame, n: int = 4, radius: int = 4, blocks: int = 6, chunk: int = 8192) -> DataFrame:
    """Classes of documents whose 64-bit fingerprints link at ``radius`` or fewer differing bits: one row
    (doc_id, fingerprint, component_id) for each row of ``docs``.

    component_id is the smallest doc_id that links reach. Equal fingerprints are one node before anything is compared, so
    thousands of exact copies cost one comparison. Rows with a null doc_id keep their row and may join a class, but
    don't name one unless it holds no other. Repeated rows get equal results. An empty table gives an empty result.
    Extra columns are not read; texts of any length are read whole. Rows of a fingerprint that very many share are not dealt
    by it.
    """
    prints = written(fingerprints(docs, n), "fingerprints")
    nodes = written(prints.groupBy("f0").agg(F.min("doc_id").alias("low"), F.count("*").alias("held")), "nodes")
    links = linked(nodes.select(F.col("f0").alias("id"), "f0"), block_keys(64, radius, blocks), 64, radius, chunk)
    parts = components(links, "simhash")
    named = nodes.join(parts, nodes.f0 == parts.node, "left").select("f0", "low", "held", F.coalesce("component", "f0").alias("part"))
    named = written(named, "classes")
    low = named.groupBy("part").agg(F.min("low").alias("component_id"), F.count("*").alias("prints"))
    of_print = looked_up(named, low, "part", "prints", named.count()).select("f0", "held", "component_id")
    out = looked_up(prints, of_print, "f0", "held", prints.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


# ------------------------------------------------------------------------------- near-duplicates by exact similarity


def set_links(sets: list[np.ndarray], similarity: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect all sets connected by a Jaccard similarity of at least ``similarity``; with ``side``, only
    pairs across the two sides count. A search from each set counts shared members through an inverted list, and sets that
    were reached are not asked for again, so groups around one original cost about their size."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(number, kind="stable")
    holders, first = owner[order], np.r_[0, np.cumsum(np.bincount(number, minlength=len(values)))]
    start = np.r_[0, np.cumsum(size)]
    group, found = np.arange(n), []

    def near(i: int) -> np.ndarray:
        own = number[start[i] : start[i + 1]]
        count = first[own + 1] - first[own]
        at = np.repeat(first[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(holders[at], minlength=n)
        good = both >= similarity * (size + size[i] - both)
        good &= group != group[i]
        if side is not None:
            good &= side != side[i]
        return np.flatnonzero(good)

    waiting, asked = list(range(n - 1, -1, -1)), np.zeros(n, bool)
    while waiting:
        i = waiting.pop()
        if asked[i]:
            continue
        asked[i] = True
        if (group == group[i]).all():
            break
        hit = near(i)
        if len(hit):
            value, at = np.unique(group[hit], return_index=True)
            found += [(i, int(hit[k])) for k in at]
            group[np.isin(group, value)] = group[i]
            waiting += hit.tolist()
    return found


def near_duplicate_classes(docs: DataFrame, n: int = 5, similarity: float = 0.8, bits: int = 256, radius: int = 68, bucket: int = 512, recall: float = 0.998, short: int = 20, weight: int = 1_000_000) -> DataFrame:
    """(doc_id, component_id) for each row with a doc_id: documents link at a Jaccard similarity of their sets of ``n``-word
    shingles of at least ``similarity``; component_id is the smallest doc_id that links reach.

    Candidates are fingerprints of ``bits`` bits within ``radius`` that agree on some draw of bits. Draws are so wide that even
    buckets would hold at most ``bucket`` of the texts, so comparisons of a text stay about as many whatever the size of the table,
    and :func:`draws_for` tells how many draws it takes that pairs at the similarity share a bucket with a probability of
    ``recall``. At a similarity of 0.8 a bit differs with a probability of 0.15, so the expected distance is 39 of 256 with a
    deviation of 6. Fingerprints of texts that have little in common differ in 128 bits or somewhat less, with a deviation of 8, so
    hardly any are within the radius, and groups of candidates don't grow together in large tables. Fingerprints of few shingles
    spread more, so pairs of which one set
    has at most ``short`` shingles are found exactly: in one order of all shingles, two sets that similar share one of the first
    size - ceil(similarity * size) + 1 of each. Groups of candidates are then compared exactly. Documents with equal shingle
    sets are one node from the start. A group of more than ``weight`` shingles is split into chunks, and each
    pair of chunks is compared by itself. Texts without words are equal to each other.
    """
    m = bits // 64
    cols = [f"f{k}" for k in range(m)]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                prints, content, size, first = [], [], [], []
                for t in part.column(1):
                    raw = sorted(xxhash.xxh128_digest(s, 42) for s in set(shingles(words(t.as_py()), n)))
                    joined = b"".join(raw)
                    prints.append(majority(widened(np.frombuffer(joined, np.uint64).reshape(-1, 2), bits), bits))
                    content.append(xxhash.xxh128_digest(joined, 1))
                    size.append(len(raw))
                    many = len(raw) - math.ceil(similarity * len(raw) - 1e-9) + 1 if 0 < len(raw) <= short / similarity else 0
                    first.append(np.frombuffer(b"".join(raw[:many]), np.int64)[::2])
                f = np.array(prints, np.uint64).reshape(-1, m)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(f[:, k]).view(np.int64)) for k in range(m)), pa.array(content, pa.binary()), pa.array(size, pa.int64()), pa.array(first, pa.list_(pa.int64()))], ["doc_id", *cols, "content", "size", "first"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    prints = written(rows.mapInArrow(digest, "doc_id long, " + ", ".join(f"{c} long" for c in cols) + ", content binary, size long, first array<long>"), "prints")
    nodes = written(prints.groupBy("content").agg(F.min("doc_id").alias("id"), F.count("*").alias("held"), *(F.first(c).alias(c) for c in cols), F.first("size").alias("size"), F.first("first").alias("first")), "nodes")
    width = max(4, math.ceil(math.log2(max(1, nodes.count()) / bucket)))
    draws = drawn_keys(bits, width, draws_for(bits, width, similarity, recall))
    filled = nodes.filter("size > 0").select("id", *cols)
    # the first draws join most of a large group; the others then return links between what is still apart only
    early = written(components(linked(filled, draws[:4], bits, radius), "early"), "early")
    labelled = filled.join(early, filled.id == early.node, "left").select("id", *cols, F.coalesce("component", "id").alias("label"))
    late = linked(labelled, draws[4:], bits, radius).unionByName(early.select(F.col("node").alias("a"), F.col("component").alias("b")))
    firsts = nodes.select("id", F.explode("first").alias("shingle"))
    lowest = firsts.groupBy("shingle").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").select("shingle", "b")
    late = late.unionByName(firsts.join(lowest, "shingle").filter("id <> b").select(F.col("id").alias("a"), "b"))
    groups = written(components(late, "candidates").join(nodes.select(F.col("id").alias("node"), "size"), "node"), "groups")
    big = groups.groupBy("component").agg(F.ceil(F.sum("size") / weight).alias("parts")).filter("parts > 1")
    placed = groups.join(big, "component", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int"))
    meets = F.expr("transform(sequence(0, cast(coalesce(parts, 1) as int) - 1), x -> struct(least(x, own) AS i, greatest(x, own) AS j, int(own > x) AS side))")
    placed = placed.select("node", "component", F.explode(meets).alias("p")).select("node", "component", "p.*")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(words(t.as_py()), n)], np.uint64)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.int64()))], ["node", "members"])

    texts = rows.join(groups.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    held = texts.mapInArrow(sets, "node long, members array<long>")
    tasks = placed.join(held, "node").groupBy("component", "i", "j").agg(F.collect_list(F.struct("side", "node", "members")).alias("rows"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                own = batch.column(2)[k].values
                lists, ids = own.field(2), own.field(1).to_numpy()
                cut, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                side = own.field(0).to_numpy() if batch.column(0)[k].as_py() != batch.column(1)[k].as_py() else None
                for i, j in set_links([flat[x:y] for x, y in zip(cut, cut[1:])], similarity, side):
                    a.append(ids[i])
                    b.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = tasks.select("i", "j", "rows").mapInArrow(exact, "a long, b long")
    parts = components(links, "duplicates")
    named = nodes.join(parts, nodes.id == parts.node, "left").select("content", "held", F.coalesce("component", "id").alias("component_id"))
    return looked_up(prints.select("doc_id", "content"), named, "content", "held", prints.count()).select("doc_id", "component_id")


def without_near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, but for documents in a class with a smaller doc_id. Rows with a null
    doc_id stay; rows that repeat a doc_id stay or go together."""
    gone = near_duplicate_classes(docs, n, similarity).filter("doc_id <> component_id").select("doc_id").distinct()
    gone = written(gone, "gone")
    return docs.join(gone, docs.doc_id.cast("long") == gone.doc_id, "left_anti")
