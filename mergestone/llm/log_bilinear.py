"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are the words of :func:`mergestone.llm.simhash.words` and one end token a document. The ``head`` commonest tokens are
symbols of their own; every other word belongs to one of ``classes`` symbols by its last two bytes. Symbols are dealt to
``groups`` by frequency, common ones to small groups. The model gives

    P(token | context) = P(group | context) * P(symbol | group, context) * P(word | class)

The first two are log-bilinear: the embeddings of the last ``order`` symbols, one table for each position, sum up to a predicted
embedding, whose products with the output embeddings of all groups, and of all symbols of a group, plus biases, are normalised;
so a token costs products with some tens of embeddings instead of one with each symbol. P(word | class) is the word's training
count less an absolute discount, and what the discounts leave goes to words not seen in training, which count as one token, as
in the base. So the probabilities of all tokens sum to one.

Spark: word counts are combined in tasks, then summed by word. Training runs in every task over all its training tokens,
from one start; the tasks' parameters are averaged by Spark, weighted by tokens, so scores depend a little on how rows are
dealt to tasks. Scoring looks the commonest words up in a table of fixed size; all others are joined with the counts by hash,
so nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.llm import word_table as W
from mergestone.llm.shared import at_most, written

END = b""  # no word is empty, so this stands for the end token
SEED = 7
#: Distinct words that a task gathers before it passes their counts on.
FLUSH = 1_000_000
#: Tokens of a step of training.
BATCH = 4096


@dataclass(frozen=True)
class Shape:
    head: int = 768
    classes: int = 256
    groups: int = 32
    order: int = 3
    size: int = 12
    #: Commonest words whose counts every task holds; all others are joined.
    table: int = 50_000
    #: Noise groups that a batch shares, and noise symbols of the own group that each token has.
    noise: int = 16
    inner: int = 4
    rate: float = 0.1

    @property
    def symbols(self) -> int:
        return self.head + self.classes


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-2:]) % classes


@lru_cache(2)
def endings(classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words of one byte, and of all last two bytes, the first of them counting 256."""
    return np.array([class_of(bytes([a]), classes) for a in range(256)]), np.array([class_of(bytes([a, b]), classes) for a in range(256) for b in range(256)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Input embeddings for each position (one more for what stands before a text), output embeddings and biases of groups and
    of symbols; those of symbols are kept in the order of ``place``, in which the symbols of a group are neighbours."""

    #: Noise symbols of each group, drawn in proportion to the prior, but for a tenth that is dealt evenly.
    DRAWS = 8192

    def __init__(self, shape: Shape, prior: np.ndarray):
        rng, s = np.random.default_rng(SEED), shape
        prior = np.maximum(prior, 1e-9) / np.maximum(prior, 1e-9).sum()
        self.shape, groups = s, min(s.groups, s.symbols)
        order = np.argsort(-prior, kind="stable")
        share = np.sqrt(prior[order])
        group = np.minimum(groups - 1, (groups * (np.cumsum(share) - share / 2) / share.sum()).astype(np.int64))
        group = np.unique(group, return_inverse=True)[1]
        self.first = np.append(0, np.cumsum(np.bincount(group)))
        self.place, self.group = np.empty(s.symbols, np.int64), np.empty(s.symbols, np.int64)
        self.place[order], self.group[order] = np.arange(s.symbols), group
        mass = np.add.reduceat(prior[order], self.first[:-1])
        inner = prior[order] / mass[group]
        draws = []
        for a, b in zip(self.first, self.first[1:]):
            p = 0.9 * inner[a:b] / inner[a:b].sum() + 0.1 / (b - a)
            draws.append(a + np.minimum(b - a - 1, np.searchsorted(np.cumsum(p), (np.arange(self.DRAWS) + 0.5) / self.DRAWS)))
        self.draws = np.array(draws)
        drawn = np.maximum(1, np.bincount(self.draws.ravel(), minlength=s.symbols)) / self.DRAWS
        self.mass = mass.astype(np.float32)
        self.log_k, self.log_j = np.log(s.noise * mass).astype(np.float32), np.log(s.inner * drawn).astype(np.float32)
        self.many = np.diff(self.first) > 1
        self.inp = rng.normal(0, 0.1, (s.order * (s.symbols + 1), s.size)).astype(np.float32)
        self.top, self.top_bias = rng.normal(0, 0.05, (len(mass), s.size)).astype(np.float32), np.log(mass).astype(np.float32)
        self.out, self.bias = rng.normal(0, 0.05, (s.symbols, s.size)).astype(np.float32), np.log(inner).astype(np.float32)
        self.tokens = 0

    def parts(self) -> list[np.ndarray]:
        return [self.inp, self.top, self.top_bias, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def contexts(self, symbol: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(tokens, order): the symbols before each token of texts that begin at these tokens, the nearest first."""
        out = np.full((len(symbol), self.shape.order), self.shape.symbols, np.int64)
        since = np.arange(len(symbol)) - np.repeat(begin, np.diff(begin, append=len(symbol)))
        for j in range(self.shape.order):
            out[j + 1 :, j] = symbol[: max(0, len(symbol) - j - 1)]
            out[since <= j, j] = self.shape.symbols
        return out

    def rows(self, ctx: np.ndarray) -> np.ndarray:
        return ctx + np.arange(self.shape.order) * (self.shape.symbols + 1)

    def log_probability(self, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the normalised probability of each target symbol, by products of whole batches."""
        out = np.empty(len(target))
        group, place = self.group[target], self.place[target]
        for lo in range(0, len(target), 65536):
            part = slice(lo, lo + 65536)
            q = self.inp[self.rows(ctx[part])].sum(axis=1)
            own = group[part]
            got = normalised(q, self.top, self.top_bias, own)
            order = np.argsort(own.astype(np.int16), kind="stable")
            cut = np.searchsorted(own[order], np.arange(len(self.mass) + 1))
            for g in np.flatnonzero(self.many & (np.diff(cut) > 0)).tolist():
                i, (a, b) = order[cut[g] : cut[g + 1]], self.first[g : g + 2]
                got[i] += normalised(q[i], self.out[a:b], self.bias[a:b], place[part][i] - a)
            out[part] = got
        return out

    def start(self) -> None:
        self.squares = [np.full(p.shape, 0.1, np.float32) for p in self.parts()]
        self.rng = np.random.default_rng(SEED)

    def step(self, ctx: np.ndarray, target: np.ndarray) -> None:
        """One step of noise-contrastive estimation: tell the groups of targets from ``noise`` groups, shared by the batch, and
        targets from ``inner`` symbols of their groups."""
        s, b = self.shape, len(target)
        rows, g, t = self.rows(ctx), self.group[target], self.place[target]
        q = self.inp[rows].sum(axis=1)
        noise = np.minimum(len(self.mass) - 1, np.searchsorted(np.cumsum(self.mass), self.rng.random(s.noise)))
        r, rn = self.top[g], self.top[noise]
        true = sigmoid((q * r).sum(1) + self.top_bias[g] - self.log_k[g]) - 1
        false = sigmoid(q @ rn.T + self.top_bias[noise] - self.log_k[noise])
        dq = true[:, None] * r + false @ rn
        d_top = np.zeros_like(self.top)
        np.add.at(d_top, noise, false.T @ q)
        d_top += sums(g, true[:, None] * q, len(d_top))
        d_top_bias = np.bincount(g, true, len(d_top)) + np.bincount(noise, false.sum(0), len(d_top))

        u = np.empty((b, s.inner + 1), np.int64)  # the target, then its noise
        u[:, 0] = t
        u[:, 1:] = self.draws[g[:, None], self.rng.integers(0, self.DRAWS, (b, s.inner))]
        e = self.out[u]
        z = sigmoid(np.einsum("bjd,bd->bj", e, q) + (self.bias - self.log_j)[u])
        z[:, 0] -= 1
        z *= self.many[g][:, None]
        dq += np.einsum("bj,bjd->bd", z, e)
        d_out = sums(u.ravel(), (z[:, :, None] * q[:, None, :]).reshape(-1, s.size), len(self.out))
        d_bias = np.bincount(u.ravel(), z.ravel(), len(self.out))
        d_inp = sums(rows.ravel(), np.repeat(dq, s.order, axis=0), len(self.inp))
        for p, sq, d in zip(self.parts(), self.squares, (d_inp, d_top, d_top_bias, d_out, d_bias)):
            d = (d / np.float32(np.sqrt(b))).astype(np.float32)
            sq += d * d
            d *= np.float32(s.rate)
            d /= np.sqrt(sq)
            p -= d
        self.tokens += b


def sums(i: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, width): the rows of each number, added up. Sorting 16-bit numbers takes time in proportion."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    order = np.argsort(i.astype(np.uint16), kind="stable") if n < 1 << 16 else np.argsort(i, kind="stable")
    i = i[order]
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    out[i[first]] = np.add.reduceat(rows[order], first)
    return out


def normalised(q: np.ndarray, out: np.ndarray, bias: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Log-softmax of q @ out.T + bias, at column ``which`` of each row."""
    weights, got = np.ascontiguousarray(out.T), np.empty(len(q), np.float32)
    bound = np.sqrt((q * q).sum(axis=1).max(initial=0) * (out**2).sum(axis=1).max(initial=0)) + np.abs(bias).max(initial=0)
    for lo in range(0, len(q), 2048):  # products that stay in the processor's cache
        score = q[lo : lo + 2048] @ weights
        score += bias
        if bound > 60:  # no score can exceed the bound, so beyond it only the exponentials need shifting
            score -= score.max(axis=1, keepdims=True)
        own = score[np.arange(len(score)), which[lo : lo + 2048]]
        np.exp(score, out=score)
        got[lo : lo + 2048] = own - np.log(score @ np.ones(len(bias), np.float32))
    return got


def held_out():
    """Rows that nothing is learnt from; a null doc_id counts as an empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, h long, c long) over all whole texts; h is the word's key, and the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, spelt, keys, count = W.Numbers(), W.Runs(np.uint8), [], np.zeros(0, np.int64)
        ends = 0

        def out() -> pa.RecordBatch:
            size = np.append(np.diff(spelt.start[: spelt.n + 1]), 0)
            own = np.concatenate([*keys, W.keys(np.zeros(8, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))])
            return pa.RecordBatch.from_arrays([W.binaries(spelt.flat[: spelt.start[spelt.n]], size), pa.array(own.view(np.int64)), pa.array(np.append(count, ends))], ["word", "h", "c"])

        for batch in batches:
            for lo, hi in W.pieces_of(batch.column(0)):
                raw, start = W.bytes_of(batch.column(0).slice(lo, hi - lo))
                raw = W.LOWER[raw]
                begin, end, _ = W.spans(raw, start)
                h = W.keys(raw, begin, end)
                number, new = numbers.found(h)
                spelt.add(*W.cut_out(raw, begin[new], end[new]))
                keys.append(h[new])
                count = np.concatenate([count, np.zeros(len(new), np.int64)]) + np.bincount(number, minlength=len(numbers))
                ends += hi - lo
                if len(numbers) > FLUSH:
                    yield out()
                    numbers.clear()
                    spelt.clear()
                    keys, count, ends = [], count[:0], 0
        if ends:
            yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, h long, c long").groupBy("word").agg(F.min("h").alias("h"), F.sum("c").alias("c"))


@dataclass
class Tokens:
    """The tokens of some texts, each text's end token behind its words: numbers among the commonest words or -1, symbols, keys;
    and where each text begins."""

    at: np.ndarray
    symbol: np.ndarray
    key: np.ndarray
    begin: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.begin, append=len(self.at))


@dataclass
class Lexicon:
    """What every task holds: the commonest words in order, with counts, and sums over the rest; of bounded size."""

    shape: Shape
    words: list[bytes]
    counts: np.ndarray
    n: int
    v: int
    discount: float
    class_n: np.ndarray
    class_v: np.ndarray

    def prepare(self) -> Lexicon:
        s = self.shape
        size = np.array(list(map(len, self.words)), np.int64)
        end = np.cumsum(size)
        raw = np.frombuffer(b"".join(self.words) + bytes(8), np.uint8)
        self.index = W.Numbers()
        self.index.add(W.keys(raw, end - size, end))
        self.symbol = np.array([i if i < s.head else s.head + class_of(w, s.classes) for i, w in enumerate(self.words)], np.int64)
        share = np.concatenate([np.pad(self.counts[: s.head], (0, max(0, s.head - len(self.counts)))), self.class_n])
        self.prior = (share + 0.5) / (share + 0.5).sum()
        return self

    def read(self, column: pa.Array) -> Tokens:
        s = self.shape
        raw, start = W.bytes_of(column)
        raw = W.LOWER[raw]
        begin, end, first = W.spans(raw, start)
        texts = len(start) - 1
        place = np.arange(len(begin)) + np.repeat(np.arange(texts), np.diff(first))  # an end token stands behind each text
        key = np.full(len(begin) + texts, W.keys(raw, np.zeros(1, np.int64), np.zeros(1, np.int64))[0])
        key[place] = W.keys(raw, begin, end)
        at = self.index.find(key)
        symbol = self.symbol[at] if len(self.symbol) else np.zeros(len(at), np.int64)
        one, two = endings(s.classes)
        last = raw[np.maximum(end - 1, 0)]
        by_end = np.full(len(key), class_of(END, s.classes))
        by_end[place] = np.where(end - begin > 1, two[raw[np.maximum(end - 2, 0)].astype(np.int64) << 8 | last], one[last])
        rare = at < 0
        symbol[rare] = s.head + by_end[rare]
        return Tokens(at, symbol, key, first[:-1] + np.arange(texts))

    def word_log10(self, c, k):
        """log10 P(word | class k) of a word seen c times in training; of one not seen, that of all such words."""
        n, v = self.class_n[k], self.class_v[k]
        seen = np.log10(np.maximum(c - self.discount, 1e-12) / np.maximum(n, 1))
        new = np.log10(np.where(n > 0, self.discount * v / np.maximum(n, 1), 1.0))
        return np.where(c > 0, seen, new)


def lexicon(counts: DataFrame, shape: Shape) -> Lexicon:
    top = sorted(at_most(counts, "c", shape.table).collect(), key=lambda r: (-r.c, bytes(r.word)))
    total = counts.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    k = (F.crc32(F.expr("substring(word, greatest(length(word) - 1, 1), 2)")) % shape.classes).cast("int").alias("k")
    head = {bytes(r.word) for r in top[: shape.head]}
    by = {r.k: (r.n, r.v) for r in counts.groupBy(k).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n, v = np.zeros(shape.classes, np.int64), np.zeros(shape.classes, np.int64)
    for i, (a, b) in by.items():
        n[i], v[i] = a, b
    for r in top[: shape.head]:  # the head's words are symbols of their own
        i = class_of(bytes(r.word), shape.classes)
        n[i] -= r.c
        v[i] -= 1
    assert len(head) == min(shape.head, len(top))
    one, two = (total[2] or 0), (total[3] or 0)
    discount = min(0.95, max(0.3, one / max(1, one + 2 * two)))
    return Lexicon(shape, [bytes(r.word) for r in top], np.array([r.c for r in top], np.int64), total[0] or 0, total[1], discount, n, v)


def train(docs: DataFrame, lex: Lexicon) -> np.ndarray:
    """Parameters of the model, averaged over tasks; each task trains on all tokens of its part of ``docs``."""
    shape = lex.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lex.prepare()
        model = Model(shape, own.prior)
        model.start()
        rng = np.random.default_rng(SEED)
        for batch in batches:
            for lo, hi in W.pieces_of(batch.column(0)):
                read = own.read(batch.column(0).slice(lo, hi - lo))
                ctx, order = model.contexts(read.symbol, read.begin), rng.permutation(len(read.symbol))
                for k in range(0, len(order), BATCH):
                    i = order[k : k + BATCH]
                    model.step(ctx[i], read.symbol[i])
        if model.tokens:
            flat = model.flat().astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64())), pa.array([float(model.tokens)])], ["p", "n"])

    each = docs.select(F.col("text").cast("string")).mapInArrow(run, "p array<double>, n double")
    each = each.select("n", F.posexplode("p").alias("i", "x"))
    mean = each.groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).toArrow()  # as many rows as parameters
    flat = Model(shape, lex.prepare().prior).flat()
    flat[mean.column("i").to_numpy()] = mean.column("x").to_numpy()
    return flat


def score_documents(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:  # noqa: B008
    """One row (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, plain_score) for each row of ``docs``.

    plain_score is the score with P(symbol) in place of P(symbol | context): what score has above it is the trained model's.
    A null or empty text holds the end token alone; a text of any length is scored as a whole. Where nothing can be learnt (an
    empty table, or held-out rows only) the counts are zero and the scores follow from the formulas. Repeated rows are scored
    each; extra columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    learnt = rows.filter("not held_out")
    counts = written(count_words(learnt), "counts")
    lex = lexicon(counts, shape)
    flat = train(learnt, lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lex.prepare()
        model = Model(shape, own.prior).load(flat)
        row = TaskContext.get().partitionId() << 40
        floor = np.log10(own.n + 0.1 * (own.v + 1))
        log_c = np.append(np.log10(own.counts + 0.1) - floor, -floor)  # the last: words outside the table
        of_word = np.zeros(len(own.words) + 1)
        if len(own.words) > shape.head:
            of_word[shape.head : -1] = own.word_log10(own.counts[shape.head :], own.symbol[shape.head :] - shape.head)
        prior = np.log10(own.prior)
        kind = pa.struct([("h", pa.int64()), ("n", pa.int32()), ("k", pa.int32())])
        for batch in batches:
            for lo, hi in W.pieces_of(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                t = own.read(part.column(1))
                log_p = model.log_probability(model.contexts(t.symbol, t.begin), t.symbol) / np.log(10)
                total = lambda x, t=t: np.add.reduceat(x, t.begin)  # every text has a token
                words = total(of_word[t.at])
                rare = np.flatnonzero(t.at < 0)
                text = np.repeat(np.arange(len(t.begin)), t.size)[rare]
                order = np.lexsort((t.key[rare], text))
                rare, text = rare[order], text[order]
                new = np.append(True, (t.key[rare][1:] != t.key[rare][:-1]) | (text[1:] != text[:-1])) if len(rare) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                times = np.diff(first, append=len(rare))
                one = pa.StructArray.from_arrays([pa.array(t.key[rare[first]].view(np.int64)), pa.array(times.astype(np.int32)), pa.array((t.symbol[rare[first]] - shape.head).astype(np.int32))], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[first], np.arange(len(t.begin) + 1)).astype(np.int32)), one)
                cols = {
                    "doc_id": part.column(0), "held_out": part.column(2), "row": pa.array(row + np.arange(len(t.begin))), "n_tokens": pa.array(t.size), "n_known": pa.array(total((t.at >= 0).astype(np.int64))),
                    "base": pa.array(total(log_c[t.at])), "score": pa.array(total(log_p) + words), "plain": pa.array(total(prior[t.symbol]) + words), "rare": lists,
                }
                row += len(t.begin)
                yield pa.RecordBatch.from_pydict(cols)

    kind = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, score double, plain double, rare array<struct<h: long, n: int, k: int>>"
    scored = written(rows.select("doc_id", "text", "held_out").mapInArrow(run, kind), "scored")
    rare = scored.select("row", F.inline("rare"))
    cut = counts.filter(F.col("c") < int(lex.counts[-1])) if len(lex.counts) else counts  # the table holds all others
    cut = cut.groupBy("h").agg(F.max("c").alias("c"))
    sums = scored.sparkSession.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(lex.class_n, lex.class_v))], "k int, kn long, kv long")
    rare = rare.join(cut, "h", "left").join(F.broadcast(sums), "k")  # one row a class
    new = F.when(F.col("kn") > 0, F.log10(F.lit(lex.discount) * F.col("kv") / F.col("kn"))).otherwise(0.0)
    word = F.when(F.col("c").isNull(), new).otherwise(F.log10((F.col("c") - lex.discount) / F.col("kn")))
    extra = rare.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more_base"), F.sum(F.col("n") * word).alias("more_score"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("more_known")
    )
    out = scored.drop("rare").join(extra, "row", "left")
    add = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias
    return out.select(
        "doc_id", "held_out", "n_tokens", add("n_known", "more_known")("n_known"), F.lit(lex.n).cast("long").alias("train_tokens"),
        add("base", "more_base")("base_score"), add("score", "more_score")("score"), add("plain", "more_score")("plain_score"),
    )
