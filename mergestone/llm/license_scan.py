"""Licence scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

For a template of L words, windows of three steps of s words begin at every step, s being the least of 3, 4, 5, 6, 7, 8, 10 and so
on that is L / 2 or more, so any stretch of L words lies wholly in one of them. A window that holds four fifths of a template's
shingles has a Jaccard similarity of about 0.43 or more with it. A band is one MinHash value, so with ``bands`` = 14 such a
window misses the template with a probability of about 0.0004. What the bands retrieve is compared exactly: the share of the template's shingles in the window.

Documents are independent rows: Spark deals them to tasks, templates are a fixed list, and nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.llm.license_templates import TEMPLATES
from mergestone.llm import word_table as W
from mergestone.llm.word_hashes import hashes, hashes_of, runs

SHINGLE = 3
STEPS = tuple(sorted(b << k for b in (3, 4, 5, 7) for k in range(20)))


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], bands: int = 14, least: float = 0.8):
        rng = np.random.default_rng(5)
        self.a = rng.integers(0, 2**63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.least = least
        self.names, self.sets, self.lengths, by_step = [], [], [], {}
        for name, notices in templates.items():
            for notice in notices:
                h = hashes_of(notice)
                self.names.append(name)
                self.sets.append(np.unique(runs(h, SHINGLE)))
                self.lengths.append(len(runs(h, SHINGLE)))
                by_step.setdefault(next(s for s in STEPS if 2 * s >= len(h)), []).append((len(self.names) - 1, len(h)))
        #: step -> for each band, MinHash values in order, and their templates
        self.bands = {}
        for step, members in by_step.items():
            low = np.array([[(self.sets[t] * a).min() for t, _ in members] for a in self.a])
            order = low.argsort(axis=1)
            self.bands[step] = np.take_along_axis(low, order, 1), np.array([t for t, _ in members])[order]

    def retrieved(self, shingles: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first, end) of windows, in shingles, that share a band with a template."""
        out: set[tuple[int, int, int]] = set()
        n = len(shingles)
        for band, a in enumerate(self.a):
            hashed = shingles * a
            low: dict[int, np.ndarray] = {}
            for step, (values, which) in self.bands.items():
                window = self.windows(hashed, step, low)
                value, template = values[band], which[band]
                if len(value) <= 8:
                    hits = [(k, w) for k in range(len(value)) for w in np.flatnonzero(window == value[k])]
                else:
                    at = np.searchsorted(value, window)
                    some = np.flatnonzero(value[np.minimum(at, len(value) - 1)] == window)
                    hits = [(k, w) for w in some for k in range(at[w], np.searchsorted(value, window[w], "right"))]
                out.update((int(template[k]), int(w) * step, min(n, (int(w) + 3) * step)) for k, w in hits)
        return out

    def blocks(self, hashed: np.ndarray, step: int, low: dict[int, np.ndarray]) -> np.ndarray:
        """Minimum of every block of ``step`` values; that of double blocks from that of single ones."""
        got = low.get(step)
        if got is None:
            if step % 2 == 0 and step > 4:
                half = self.blocks(hashed, step // 2, low)
                got = half[0::2].copy()
                odd = half[1::2]
                np.minimum(got[: len(odd)], odd, out=got[: len(odd)])
            else:
                got = hashed[0::step].copy()
                for k in range(1, step):
                    part = hashed[k::step]
                    np.minimum(got[: len(part)], part, out=got[: len(part)])
            low[step] = got
        return got

    def windows(self, hashed: np.ndarray, step: int, low: dict[int, np.ndarray]) -> np.ndarray:
        block = self.blocks(hashed, step, low)
        window = block.copy()
        np.minimum(window[:-1], block[1:], out=window[:-1])
        np.minimum(window[:-2], block[2:], out=window[:-2])
        return window

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        return self.scan_all(pa.array([text], pa.string()))[0]

    def scan_all(self, texts: pa.Array) -> list[list[tuple[str, float, int, int]]]:
        """For each text (licence, containment, first word, words) of every stated notice; of overlapping ones of a licence the
        best. The texts' shingles are looked through end to end; a window over two texts is verified in each by itself."""
        h, first = hashes(texts)
        words = np.diff(first)
        each = [runs(h[a:b], SHINGLE) for a, b in zip(first.tolist(), first[1:].tolist())]
        start = np.r_[0, np.cumsum([len(x) for x in each])]
        shingles = np.concatenate(each) if each else np.zeros(0, np.uint64)
        found: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
        for t, lo, hi in self.retrieved(shingles):
            d = int(np.searchsorted(start, lo, "right")) - 1
            while d < len(texts) and start[d] < hi:
                a, b = max(lo, int(start[d])), min(hi, int(start[d + 1]))
                part = shingles[a:b]
                here = np.flatnonzero(np.isin(part, self.sets[t]))
                for first in here:  # a stretch of the template's length that begins with one of its shingles
                    own = here[(here >= first) & (here < first + self.lengths[t])]
                    share = len(np.unique(part[own])) / len(self.sets[t])
                    if share >= self.least:
                        found[d].append((self.names[t], share, a - int(start[d]) + int(first), int(own[-1] - first) + min(SHINGLE, int(words[d]))))
                d += 1
        return [self.apart(f) for f in found]

    def apart(self, found: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
        """The best ones of a licence first, those that overlap none of the ones before; those kept are held in order, so each is
        compared with its neighbours alone."""
        out: list[tuple[str, float, int, int]] = []
        held: dict[str, list[tuple[int, int]]] = {}
        for x in sorted(set(found), key=lambda f: (f[0], -f[1], -f[3], f[2])):
            own = held.setdefault(x[0], [])
            at = bisect(own, (x[2], x[2]))
            if (at == 0 or own[at - 1][1] <= x[2]) and (at == len(own) or own[at][0] >= x[2] + x[3]):
                own.insert(at, (x[2], x[2] + x[3]))
                out.append(x)
        return sorted(out, key=lambda f: (f[2], f[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """One row (doc_id, license, containment, first_word, n_words) for each notice found in the whole text of each row.

    Null and empty texts state nothing. Repeated rows give repeated results; a null doc_id stays null; extra columns are not
    read; an empty table gives an empty result. Of notices of one licence that overlap, the fullest counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least=least)
        for batch in batches:
            for lo, hi in W.pieces_of(batch.column(1), 500_000):
                part = batch.slice(lo, hi - lo)
                rows = [(d, *m) for d, found in zip(part.column(0).to_pylist(), scanner.scan_all(part.column(1))) for m in found]
                cols = list(zip(*rows)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "license", "containment", "first_word", "n_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, containment double, first_word long, n_words long")
