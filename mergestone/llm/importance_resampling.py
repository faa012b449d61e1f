"""Importance resampling towards a target: documents drawn by how much likelier their words are in the target than in the corpus.

Features of a text are its words and, with ``longest`` = 2, its pairs of neighbouring words; a feature's bucket is its crc32 modulo the
number of buckets. Counts of all features of the corpus and of the target by bucket give each bucket a gain, a document's weight is
the mean gain of its features, and Gumbel noise that depends on the document's id alone turns the largest scores into a draw
without replacement.

Most words are few words: the commonest ones (the head, of at most :data:`HEAD` words of at most 16 bytes) go to all tasks with their
CRC states, and pairs of them that are frequent (at most :data:`PAIRS`) with their buckets. A head word is recognised by all of its
bytes, so what it gets is exact. Features of the tail take the direct CRC of their bytes; a pair whose first word is in the head
starts from that word's state. Both feed the same totals, so the head changes only the work.

Spark: words are counted in tasks and summed by word, totals are summed by bucket, so what the driver holds is of fixed size. Ranks come from
a range partitioning by score, where each partition adds the number of rows before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergestone.llm import word_table as W
from mergestone.llm.shared import at_most, dropped, written

#: Bounds of what goes to all tasks.
HEAD, PAIRS = 1 << 16, 1 << 18
#: Words of the head have at most so many bytes, which two numbers hold.
SHORT = 16
#: Lower-case A-Z; what is neither a digit, a letter nor outside ASCII parts words.
FOLD = W.LOWER.copy()
FOLD[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 32
ALL = np.uint32(0xFFFFFFFF)


@lru_cache(1)
def steps() -> np.ndarray:
    """What each byte does to a CRC state, by the polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


def states(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, since: np.ndarray | None = None) -> np.ndarray:
    """CRC states after the bytes of spans, from the states ``since`` or from the start; the crc32 is the inverted state."""
    table = steps()
    out = np.full(len(begin), ALL) if since is None else since.copy()
    size, at, some = end - begin, 0, np.arange(len(begin))
    while len(some := some[size[some] > at]):
        c = out[some]
        out[some] = table[(c ^ raw[begin[some] + at]) & np.uint32(255)] ^ c >> np.uint32(8)
        at += 1
    return out


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, end, number of each text's first word) of texts in lower case."""
    raw, start = W.bytes_of(column)
    raw = FOLD[raw]
    return raw, *W.spans(raw, start)


def two_numbers(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes of spans, and the eight after them."""
    eight = np.ndarray((max(0, len(raw) - 7),), "<u8", raw.data, strides=(1,))
    size = end - begin
    more = np.zeros(len(begin), np.uint64)
    some = np.flatnonzero(size > 8)
    more[some] = eight[begin[some] + 8] & W.MASKS[np.minimum(size[some] - 8, 8)]
    return eight[begin] & W.MASKS[np.minimum(size, 8)], more


class Head:
    """Frequent words with their CRC states, and frequent pairs of them with their buckets."""

    def __init__(self, words: list[bytes], buckets: int, pairs: np.ndarray | None = None):
        self.buckets = buckets
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        raw = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
        self.size, (self.low, self.high), self.state = size, two_numbers(raw, end - size, end), states(raw, end - size, end)
        self.numbers = W.Numbers()
        key, own = np.unique(W.keys(raw, end - size, end), return_index=True) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.order = own  # of words with one key, the first
        self.numbers.add(key)
        self.pair_key = np.sort(pairs) if pairs is not None else np.zeros(0, np.int64)
        a, b = self.pair_key // HEAD, self.pair_key % HEAD
        self.pair_bucket = self.bucket(states(raw, (end - size)[b], end[b], self.after_space(self.state[a]))) if len(a) else a

    def bucket(self, state: np.ndarray) -> np.ndarray:
        return ((state ^ ALL) % np.uint32(self.buckets)).astype(np.int64)

    @staticmethod
    def after_space(state: np.ndarray) -> np.ndarray:
        return steps()[(state ^ np.uint32(32)) & np.uint32(255)] ^ state >> np.uint32(8)

    def find(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word in the head, or -1; all bytes are compared."""
        out = np.full(len(begin), -1)
        if not len(self.size) or not len(begin):
            return out
        at = self.numbers.find(W.keys(raw, begin, end)).astype(np.int64)
        hit = np.flatnonzero(at >= 0)
        own = self.order[at[hit]]
        low, high = two_numbers(raw, begin[hit], end[hit])
        same = (self.size[own] == (end - begin)[hit]) & (self.low[own] == low) & (self.high[own] == high)
        out[hit[same]] = own[same]
        return out

    def word_states(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in the head or -1, CRC state) of each word: from the table, or directly from its bytes."""
        at = self.find(raw, begin, end)
        tail = at < 0
        out = np.empty(len(begin), np.uint32)
        out[~tail] = self.state[at[~tail]]
        out[tail] = states(raw, begin[tail], end[tail])
        return at, out

    def features(self, column: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket) of all features, and the number of words of each text."""
        raw, begin, end, first = words_of(column)
        text = np.repeat(np.arange(len(column)), np.diff(first))
        at, state = self.word_states(raw, begin, end)
        buckets = [self.bucket(state)]
        owners = [text]
        if longest > 1:
            two = np.flatnonzero(text[1:] == text[:-1])
            key = np.where((at[two] >= 0) & (at[two + 1] >= 0), at[two] * HEAD + at[two + 1], -1)
            place = np.minimum(np.searchsorted(self.pair_key, key), max(0, len(self.pair_key) - 1))
            known = self.pair_key[place] == key if len(self.pair_key) else np.zeros(len(key), bool)
            out = np.empty(len(two), np.int64)
            out[known] = self.pair_bucket[place[known]]
            rest = two[~known]
            out[~known] = self.bucket(states(raw, begin[rest + 1], end[rest + 1], self.after_space(state[rest])))
            buckets.append(out)
            owners.append(text[two])
        return np.concatenate(owners), np.concatenate(buckets), np.diff(first)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def frequent(docs: DataFrame, buckets: int, longest: int) -> Head:
    """The commonest words of all documents, and pairs of them: of words of equal count, all or none."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in W.pieces_of(batch.column(0), 8_000_000):
                raw, begin, end, _ = words_of(batch.column(0).slice(lo, hi - lo))
                short = end - begin <= SHORT
                held = W.binaries(*W.cut_out(raw, begin[short], end[short])).value_counts()
                yield pa.RecordBatch.from_arrays([held.field(0), held.field(1)], ["word", "n"])

    counts = written(_texts(docs).mapInArrow(words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"), "words")
    head = Head(sorted(bytes(r[0]) for r in at_most(counts, "n", HEAD).collect()), buckets)
    dropped(counts)
    if longest < 2:
        return head

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in W.pieces_of(batch.column(0), 8_000_000):
                raw, begin, end, first = words_of(batch.column(0).slice(lo, hi - lo))
                text, at = np.repeat(np.arange(hi - lo), np.diff(first)), head.find(raw, begin, end)
                two = (text[1:] == text[:-1]) & (at[1:] >= 0) & (at[:-1] >= 0)
                key, n = np.unique((at[:-1] * HEAD + at[1:])[two], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    counts = written(_texts(docs).mapInArrow(pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1"), "pairs")
    found = np.array([r[0] for r in at_most(counts, "n", PAIRS).collect()], np.int64)
    dropped(counts)
    size, (low, high) = head.size, (head.low, head.high)
    words_again = [(int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little"))[:k] for a, b, k in zip(low, high, size)]
    return Head(words_again, buckets, found)


def bucket_totals(docs: DataFrame, head: Head, longest: int) -> np.ndarray:
    """How many features of all documents are in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(head.buckets, np.int64)
        for batch in batches:
            for lo, hi in W.pieces_of(batch.column(0)):
                held += np.bincount(head.features(batch.column(0).slice(lo, hi - lo), longest)[1], minlength=head.buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    out = np.zeros(head.buckets, np.int64)
    for r in _texts(docs).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r[0]] = r[1]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, with one more feature in each bucket."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n + 0.0) / ((a + 1.0) * (t + n + 0.0)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times Gumbel noise by the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str = "ranked") -> DataFrame:
    """``rows`` with ``place`` 1, 2, 3, ... in this order over the whole table, in ranges that are sorted by themselves. Rows that are
    equal in all of ``order`` are told apart by where they stand, so many of them aren't one task's."""
    keys = [*order, F.col("__row").asc()]
    placed = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__row")
    placed = written(placed.withColumn("__at", F.monotonically_increasing_id()), name)
    part, before, n = F.shiftright("__at", 33), [], 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row for each partition
        before.append((r[0], n))
        n += r[1]
    starts = rows.sparkSession.createDataFrame(before, "part long, before long")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", F.col("before") + inside + 1).drop("part", "before", "__at")


def resampled(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of ``docs`` (doc_id, text), for a ``target`` (text).

    Of the documents with at least ``least_words`` words, ``percent`` of a hundred are drawn: those with the highest scores, ties to
    the smaller doc_id, null ids last. ``rank`` is null for all others. A null or empty text has no features and weight 0; a null id
    has the noise of an empty one. Repeated rows stay, each with a rank of its own. Without a target's text all of its counts are
    zero. Other columns play no part.
    """
    head = frequent(docs, buckets, longest)
    gain = gains_of(bucket_totals(docs, head, longest), bucket_totals(target, head, longest))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in W.pieces_of(batch.column(1)):
                text, bucket, n = head.features(batch.column(1).slice(lo, hi - lo), longest)
                held = np.bincount(text, minlength=hi - lo)
                total = np.zeros(hi - lo, np.int64)
                np.add.at(total, text, gain[bucket])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(held), pa.array(total // np.maximum(held, 1))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = written(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    able = F.col("n_words") >= least_words
    drawn = percent * scored.filter(able).count() // 100
    out = ranked(scored.withColumn("able", able), [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("able") & (F.col("place") <= drawn), F.col("place")).alias("rank"))


#: The query's rows in DuckDB: crc32 by the polynomial, over the bytes of each distinct word.
SQL = r"""WITH crc AS (SELECT list(c ORDER BY i) AS step FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
dw AS (SELECT row, unnest(words) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
v AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM dw JOIN v USING (w) GROUP BY 1), t AS (SELECT bucket, count(*)::DOUBLE AS t FROM bw JOIN v USING (w) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM dw)::DOUBLE + 10000) / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM bw)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
f AS (SELECT row, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY 1),
o AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN f USING (row))
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM o WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place FROM o)"""
