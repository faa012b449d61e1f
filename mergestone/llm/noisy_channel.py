"""Toxicity by noisy-channel deobfuscation.

A text is taken as a clean one sent through a channel that swaps letters for look-alikes, spells words out with separators, and
repeats letters. Every stretch that may have been changed is a lattice of what each character may have stood for, each choice
with a cost; Viterbi's algorithm finds the restored stretch of the highest probability under a character trigram model of the
corpus, given the costs. The restored words are then scored by a model learnt from labels.

Spark: character counts are gathered from all documents, word counts being combined in tasks first; document counts of words
and word beginnings are gathered from all labelled training rows. What tasks are given back (character trigrams, weighted word
features) is of bounded size by shares of the whole, so it is decided alike at every size. Scoring is a map over documents; a task remembers what it has restored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.llm.shared import at_most, written

# Letters that each sign may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il",
    "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "[": "c", "}": "j", "€": "e", "£": "l", "¥": "y", "¢": "c", "§": "s", "#": "h", "&": "g", "*": "aeiou", "%": "o",
}
EDGE = ".,;:!?*$\"'()[]{}<>«»„“”‘’…-_=|~`/\\&#%^+"
#: Costs in nats of what the channel may have done.
SWAPPED, DROPPED, REPEATED, SPACED, BROKEN = 1.0, 1.5, 0.7, 1.2, 1.0
BOUNDARY = " "
SUSPECT_RUN = re.compile(r"(.)\1\1")
#: The model knows trigrams and bigrams that are at least this share of all, so at most 500,000 of each; what it has of shorter
#: contexts is summed over all trigrams, so a rarer one costs what its last two letters, and its last one, tell.
SHARE = 2e-6
#: Toxic training texts that a word or beginning must be in to be evidence: so many, and this share of all toxic ones.
LEAST, LEAST_SHARE = 3, 1e-4
#: Bound on the labelled rows used for calibration.
CALIBRATION = 20_000
BEGINNINGS = (4, 5, 6, 7, 8)
REMEMBER = 500_000


@dataclass(frozen=True)
class Counts:
    """Character trigrams, and sums over them by their last two, their first two, their last and their middle character."""

    three: dict[str, int]
    two: dict[str, int]
    after_two: dict[str, int]
    one: dict[str, int]
    after_one: dict[str, int]

    @classmethod
    def of(cls, three: dict[str, int]) -> Counts:
        def by(lo: int, hi: int) -> dict[str, int]:
            out: Counter[str] = Counter()
            for t, c in three.items():
                out[t[lo:hi]] += c
            return dict(out)

        return cls(three, by(1, 3), by(0, 2), by(2, 3), by(1, 2))


class Characters:
    """Interpolated character trigram model over letters and the word boundary."""

    def __init__(self, counts: Counts):
        self.counts, self.total = counts, max(1, sum(counts.one.values()))
        self.cache: dict[str, float] = {}

    def cost(self, t: str) -> float:
        """-log P(t[2] | t[:2])"""
        got = self.cache.get(t)
        if got is None:
            c = self.counts
            p = 0.7 * c.three.get(t, 0) / c.after_two.get(t[:2], 1) + 0.25 * c.two.get(t[1:], 0) / c.after_one.get(t[1], 1) + 0.049 * c.one.get(t[2], 0) / self.total + 1e-6
            if len(self.cache) > REMEMBER:
                self.cache.clear()
            got = self.cache[t] = -math.log(p)
        return got


def arcs(ch: str, before: str) -> list[tuple[str, float]]:
    """What a character may have stood for, with costs; an empty string: nothing."""
    if ch.isalpha():
        return [(ch, 0.0), ("", REPEATED)] if ch == before else [(ch, 0.0)]
    if ch.isspace():
        return [(BOUNDARY, 0.0), ("", SPACED)]
    out = [(c, SWAPPED) for c in LOOK_ALIKES.get(ch, "")]
    out.append((BOUNDARY, BROKEN))
    out.append(("", REPEATED if ch == before else DROPPED))
    return out


def restored(stretch: str, model: Characters) -> str:
    """Viterbi over the lattice of ``stretch``; a state is the last two characters of what was restored."""
    states: dict[str, tuple[float, tuple | None]] = {BOUNDARY * 2: (0.0, None)}
    before = ""
    for ch in stretch:
        choices = arcs(ch, before)
        before = ch
        new: dict[str, tuple[float, tuple | None]] = {}
        for h, (cost, back) in states.items():
            for c, extra in choices:
                if c == BOUNDARY and h[1] == BOUNDARY:
                    c = ""
                    extra = 0.0
                total = cost + extra
                if c:
                    total += model.cost(h + c)
                    to, link = h[1] + c, (c, back)
                else:
                    to, link = h, back
                had = new.get(to)
                if had is None or total < had[0]:
                    new[to] = (total, link)
        states = new
    cost, link = min(((c + (0.0 if h[1] == BOUNDARY else model.cost(h + BOUNDARY)), b) for h, (c, b) in states.items()), key=lambda x: x[0])
    out = []
    while link is not None:
        out.append(link[0])
        link = link[1]
    return "".join(reversed(out))


class Restorer:
    """Restored words of whole texts. Words that nothing can have been done to are kept as they are."""

    def __init__(self, counts: Counts):
        self.model = Characters(counts)
        self.plain: dict[str, tuple[str, ...] | None] = {}
        self.spelt: dict[str, tuple[str, ...]] = {}

    def decode(self, stretch: str) -> tuple[str, ...]:
        got = self.spelt.get(stretch)
        if got is None:
            if len(self.spelt) > REMEMBER:
                self.spelt.clear()
            got = self.spelt[stretch] = tuple(restored(stretch, self.model).split())
        return got

    def token(self, token: str) -> tuple[str, ...] | None:
        """Restored words of one token; None for a single character, which may be part of a word that is spelt out."""
        core = token.strip(EDGE)
        if core.isalpha():
            if len(core) == 1 and len(token) <= 3:
                return None
            if not SUSPECT_RUN.search(core):
                inner = token.strip(".,;:!?\"'()-")
                if inner == core or len(inner) - len(core) > 2:
                    return (core,)
                return tuple({core, *self.decode(inner)})  # one or two signs at an edge may be letters
            return tuple({core, *self.decode(core)})
        if not core:
            return None if len(token) == 1 else ()
        if not any(c.isalpha() for c in core) and len(core) < 3:
            return ()
        inner = token.strip(".,;:?\"'()-")
        if 0 < len(inner) - len(core) <= 2:
            return tuple({*self.decode(core), *self.decode(inner)})
        return self.decode(core)

    def words(self, text: str | None) -> set[str]:
        out: set[str] = set()
        known = self.plain
        if len(known) > REMEMBER:
            known.clear()
        low = (text or "").lower()
        for t in set(low.split()):
            try:
                got = known[t]
            except KeyError:
                got = known[t] = self.token(t)
            if got is not None:
                out.update(got)
            elif core := t.strip(EDGE):
                out.add(core)
        for run in SPELT_OUT.findall(low):
            out.update(self.decode(" ".join(run.split())))
        return out


SPELT_OUT = re.compile(r"(?<!\S)[^\w\s]?\w[^\w\s]?(?:\s+[^\w\s]?\w[^\w\s]?){2,}(?!\S)")


class Telling(dict):
    """Token -> its restored words that weigh anything as evidence; remembers tokens."""

    def __init__(self, restorer: Restorer, scorer: Scorer):
        super().__init__()
        self.restorer, self.scorer = restorer, scorer

    def __missing__(self, token: str) -> tuple[str, ...]:
        words = self.restorer.token(token)
        if words is None:
            words = (token.strip(EDGE),)
        got = self[token] = tuple(w for w in words if w and self.scorer.word(w) > 0)
        return got

    def evidence(self, text: str | None) -> list[float]:
        """The same as the evidence of :meth:`Restorer.words`, looked up token by token."""
        if len(self) > REMEMBER:
            self.clear()
        low = (text or "").lower()
        found = {w for ws in map(self.__getitem__, set(low.split())) if ws for w in ws}
        for run in SPELT_OUT.findall(low):
            found.update(self.restorer.decode(" ".join(run.split())))
        return self.scorer.evidence(found)


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "~" for k in BEGINNINGS if len(word) > k)]


def remainder(by: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % by


@lru_cache(1)
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of letters and boundaries, packed as 21 bits a character, and their counts. All that is no letter is a
    boundary; before the first letter of a word stand two of them, after its last letter one."""
    code = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    letter = letters()[code]
    code = np.where(letter, code, ord(BOUNDARY))
    one, two = code[1:-1], code[:-2]  # for the character at i + 1: itself, and the one before
    before = np.concatenate([[ord(BOUNDARY)], code[:-3]])
    before = np.where(letter[:-2], before, ord(BOUNDARY))
    inside = letter[1:-1]
    ends = inside & ~letter[2:]
    packed = np.concatenate([(before << 42 | two << 21 | one)[inside], (two << 42 | one << 21 | ord(BOUNDARY))[ends]])
    return np.unique(packed, return_counts=True)


def character_counts(docs: DataFrame) -> Counts:
    """Counts of characters over all words of all documents; see :data:`SHARE`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        three: dict[int, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                text = " ".join(t.lower() for t in batch.column(0).slice(lo, 128).to_pylist() if t)
                for k, c in zip(*(x.tolist() for x in trigram_counts(text))):
                    three[k] = three.get(k, 0) + c
        if three:
            keys = ["".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0)) for k in three]
            yield pa.RecordBatch.from_pydict({"t": keys, "c": list(three.values())})

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "t string, c long").groupBy("t").agg(F.sum("c").alias("c"))
    found = written(found.filter("length(t) = 3"), "trigrams")
    least = SHARE * (found.agg(F.sum("c")).first()[0] or 0)

    def by(lo: int, n: int, least: float) -> dict[str, int]:
        part = found.groupBy(F.substring("t", lo, n).alias("t")).agg(F.sum("c").alias("c")).filter(F.col("c") >= least).toArrow()
        return dict(zip(part.column("t").to_pylist(), part.column("c").to_pylist()))

    return Counts(by(1, 3, least), by(2, 2, least), by(1, 2, least), by(3, 1, 0), by(2, 1, 0))


@dataclass
class Scorer:
    """Weights of features, and a logistic model over the strongest evidence of a document's words."""

    weights: dict[str, float]
    beta: np.ndarray
    known: dict[str, float] = field(default_factory=dict)

    def word(self, w: str) -> float:
        got = self.known.get(w)
        if got is None:
            if len(self.known) > REMEMBER:
                self.known.clear()
            got = self.known[w] = max((self.weights.get(f, 0.0) for f in features(w)), default=0.0)
        return got

    def evidence(self, words: set[str]) -> list[float]:
        best = sorted((x for w in words if (x := self.word(w)) > 0), reverse=True)[:3]
        best += [0.0] * (3 - len(best))
        return best

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = self.beta[0] + np.asarray(evidence, float).reshape(-1, 3) @ self.beta[1:]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def learn_weights(rows: DataFrame, trigrams: Counts) -> dict[str, float]:
    """From rows (text, toxic): for each word or beginning, the lower bound of its log-likelihood ratio, where positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(trigrams)
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        n = [0, 0]

        def out() -> pa.RecordBatch:
            keys = list({*seen[0], *seen[1]})
            got = pa.RecordBatch.from_pydict({"f": keys, "p": pa.array([seen[1][k] for k in keys], pa.int64()), "n": pa.array([seen[0][k] for k in keys], pa.int64())})
            seen[0].clear()
            seen[1].clear()
            return got

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                n[y] += 1
                seen[y].update({f for w in restorer.words(text.as_py()) for f in features(w)})
                if len(seen[0]) + len(seen[1]) > 600_000:
                    yield out()
        if sum(n):
            seen[0][""], seen[1][""] = n
            yield out()

    counts = written(rows.select("text", "toxic").mapInArrow(run, "f string, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).filter(f"p >= {LEAST} or f = ''"), "features")
    total = counts.filter("f = ''").first()
    if total is None or not total.p or not total.n:
        return {}
    ratio = F.log((F.col("p") + 0.5) / (total.p + 1)) - F.log((F.col("n") + 0.5) / (total.n + 1))
    bound = ratio - 1.5 * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    best = counts.filter("f <> ''").filter(F.col("p") >= LEAST_SHARE * total.p).select("f", bound.alias("w")).filter("w > 0.5").toArrow()
    return dict(zip(best.column("f").to_pylist(), best.column("w").to_pylist()))


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, drawn towards a weight of one for the strongest evidence."""
    prior = np.array([-3.0, 1.0, 0.3, 0.3])
    a = np.hstack([np.ones((len(x), 1)), x.reshape(-1, 3)])
    beta = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -35, 35)))
        g = a.T @ (p - y) + 1.0 * (beta - prior)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.eye(4)
        beta = beta - np.linalg.solve(h, g)
    beta[1:] = np.maximum(beta[1:], 0.0)
    return beta


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Counts, Scorer]:
    """Characters from all documents; weights from three quarters of the labelled training rows, calibration from at most
    ``CALIBRATION`` of the last quarter. Training rows are those whose crc32(doc_id as text) mod 3 is not 1."""
    trigrams = character_counts(docs)
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(remainder(3) != 1)
    rows = written(texts.join(known.hint("merge"), "doc_id"), "labelled")  # both sides may be of any size
    last = remainder(4) == 1
    weights = learn_weights(rows.filter(~last), trigrams)
    scorer = Scorer(weights, np.array([-3.0, 1.0, 0.3, 0.3]))
    sample = at_most(rows.filter(last).withColumn("z", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))), "z", CALIBRATION)
    got = sample.select("text", "toxic").mapInArrow(lambda b: _evidence(b, trigrams, scorer), "a double, b double, c double, y int").toArrow()
    if got.num_rows:
        x = np.stack([got.column(c).to_numpy() for c in "abc"], axis=1)
        scorer.beta = calibrate(x, got.column("y").to_numpy().astype(float))
    return trigrams, scorer


def _evidence(batches, trigrams, scorer):
    telling = Telling(Restorer(trigrams), scorer)
    for batch in batches:
        x = np.array([telling.evidence(t.as_py()) for t in batch.column(0)], float).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(3)), batch.column(1).cast(pa.int32())], ["a", "b", "c", "y"])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) for each row of ``docs``, of its whole text only.

    A null or empty text has no evidence and gets the score of that; a text of any length is scored as a whole. Labels other than 0 and 1 are not learnt from; of repeated
    labels of a document the larger counts. Without labels of both kinds every score is that of no evidence. Extra columns are
    not read; repeated rows are scored each.
    """
    trigrams, scorer = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = Telling(Restorer(trigrams), scorer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = [telling.evidence(t.as_py()) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scorer.score(np.array(x)))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(3) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``. Rows with a null doc_id or text are
    judged by their text alone, so null and empty texts stay; other cases as in :func:`score_toxicity`."""
    trigrams, scorer = fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = Telling(Restorer(trigrams), scorer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = [telling.evidence(t.as_py()) for t in part.column(at)]
                yield part.filter(pa.array(scorer.score(np.array(x)) < threshold))

    return docs.mapInArrow(run, docs.schema)
