"""Passages that an earlier document holds as well are taken out: each window of :data:`LENGTH` words whose words also follow one another
in a document with a smaller doc_id.

Windows are brought together by content. A window's anchor is the least, by a hash, of its runs of :data:`ANCHOR` words, so equal
windows have equal anchors; neighbouring windows with one anchor are a piece of text.

1. Anchors are summed up in tasks, then by anchor: those that occur in one document only take no further part.
2. Pieces with shared anchors are dealt to shards by anchor, each text once from each batch of rows, with its smallest doc_id. A shard builds a
   compressed FM-index of its distinct pieces and streams them through it: backward search gives the matching statistics of all
   places, and of each match of a window's length the smallest doc_id of the index rows it ends at.
3. These intervals go back to the documents that hold the piece, and those found in a smaller doc_id are cut out.

Words are compared byte by byte inside the index; anchors and pieces are told apart by 64-bit hashes, as elsewhere in this package. Shards
follow from the number of shared pieces. Pieces of an anchor that is hot are dealt window by window, so their shards are many, and what
a hot piece's documents look up goes to all tasks. A bitmap of fixed size, set by the shared anchors, spares the shuffle of other
pieces; beyond what it can tell apart it lets more through, which the exact steps sort out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.llm import word_table as W
from mergestone.llm.fm_index import FMIndex, least_in
from mergestone.llm.periodic_runs import joined
from mergestone.llm.shared import HOT, dropped, looked_up, written
from mergestone.llm.word_hashes import runs as run_hashes

LENGTH, ANCHOR = 13, 5
#: Words of the distinct pieces of a shard, at most, if pieces have their usual length.
SHARD = 1_500_000
#: No anchor of fewer pieces is hot.
LEAST_HOT = 1000
#: Bits that shared anchors set: 16 MB.
BITS = 1 << 27
SPANS = "array<struct<at:int,n:int,first:bigint>>"


class Pieces:
    """Texts cut into pieces: of each its text, its anchor's hash, its first window's number (as that of its first word, among the
    words of all texts) and how many windows it has."""

    def __init__(self, column: pa.Array, length: int, anchor: int):
        raw, start = W.bytes_of(column)
        self.raw = raw
        self.begin, self.end, self.first = W.spans(raw, start)
        n = len(self.begin)
        size = np.diff(self.first)
        text = np.repeat(np.arange(len(size)), size)
        key = W.keys(raw, self.begin, self.end)
        whole = np.flatnonzero(text[length - 1 :] == text[: n - length + 1]) if n >= length else np.zeros(0, np.int64)
        if not len(whole):
            self.text = self.anchor = self.at = self.windows = np.zeros(0, np.int64)
            self.window = np.zeros(0, np.uint64)
            return
        self.window = run_hashes(key, length)
        gram, span = run_hashes(key, anchor), length - anchor + 1
        least, place, have = gram, np.arange(len(gram)), 1
        while have < span:  # the leftmost least of each span, by doubling
            step = min(have, span - have)
            left = least[:-step] <= least[step:]
            place, least = np.where(left, place[:-step], place[step:]), np.where(left, least[:-step], least[step:])
            have += step
        own = place[whole]
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (whole[1:] != whole[:-1] + 1)]))
        self.at, self.windows = whole[new], np.diff(np.append(new, len(whole)))
        self.text, self.anchor = text[self.at], gram[own[new]]

    def content(self) -> np.ndarray:
        """A hash of each piece's words: its first and last window cover it."""
        last = self.window[self.at + self.windows - 1]
        return W.mixed(self.window[self.at] * W.ODD + W.mixed(last + self.windows.astype(np.uint64)))

    def taken(self, some: np.ndarray) -> None:
        self.text, self.anchor, self.at, self.windows = self.text[some], self.anchor[some], self.at[some], self.windows[some]

    def by_window(self, hot: np.ndarray) -> np.ndarray:
        """Cut pieces of ``hot`` anchors into their windows; what each piece is to be dealt by."""
        many = np.isin(self.anchor, hot) & (self.windows > 1)
        times = np.where(many, self.windows, 1)
        ends = np.cumsum(times)
        inner = np.arange(int(times.sum())) - np.repeat(ends - times, times)
        split = np.repeat(np.isin(self.anchor, hot), times)
        at = np.repeat(self.at, times) + inner
        self.text, self.anchor, self.at = np.repeat(self.text, times), np.repeat(self.anchor, times), at
        self.windows = np.where(split, 1, np.repeat(self.windows, times))
        return np.where(split, self.window[at], self.anchor)

    def texts(self, some: np.ndarray, length: int) -> pa.Array:
        """The words of these pieces, joined by spaces."""
        lo, n = self.at[some], self.windows[some] + length - 1
        ends = np.cumsum(n)
        word = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(lo, n)
        return joined(self.raw, self.begin[word], self.end[word], np.concatenate([[0], ends]))


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.astype(np.uint64).view(np.int64))


def by_batches(function, size: int = 8_000_000):
    """A job over Arrow batches whose second column is a text, by runs of rows of about ``size`` bytes."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in W.pieces_of(batch.column(1), size):
                yield function(batch.slice(lo, hi - lo))

    return job


def shared_anchors(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """(h, held) of the anchors that documents of different doc_ids hold; held: how many pieces."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, doc = Pieces(batch.column(1), length, anchor), batch.column(0).to_numpy()
        h, back, n = np.unique(p.anchor, return_inverse=True, return_counts=True)
        own = doc[p.text]
        lo, hi = np.full(len(h), np.iinfo(np.int64).max), np.full(len(h), np.iinfo(np.int64).min)
        np.minimum.at(lo, back, own)
        np.maximum.at(hi, back, own)
        return pa.RecordBatch.from_arrays([signed(h), pa.array(lo), pa.array(hi), pa.array(n, pa.int64())], ["h", "lo", "hi", "n"])

    found = rows.select("doc_id", "text").mapInArrow(by_batches(count), "h bigint, lo bigint, hi bigint, n bigint")
    return found.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("held")).filter("lo < hi").select("h", "held")


def bitmap(anchors: DataFrame) -> np.ndarray:
    """Bits of the anchors, by their lowest bits: :data:`BITS` / 8 bytes in blocks of 4,096."""
    bit = F.col("h").bitwiseAND(F.lit(BITS - 1)) + 1  # Spark counts the bits of its bitmaps from 1
    blocks = anchors.groupBy(F.bitmap_bucket_number(bit).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in blocks.collect():
        out[(r[0] - 1) * 4096 :][: len(r[1])] = np.frombuffer(bytes(r[1]), np.uint8)
    return out


def set_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    own = (h & np.uint64(BITS - 1)).astype(np.int64)
    return bits[own >> 3] >> (own & 7).astype(np.uint8) & 1 == 1


def earliest(contents: list[pa.RecordBatch], length: int) -> pa.RecordBatch:
    """A shard: from (c, content, first, held) the spans of windows of each piece with the smallest doc_id that holds them, of the pieces
    of which a document can lose a window."""
    table = pa.Table.from_batches(contents)
    c, at, back = np.unique(table["c"].to_numpy(), return_index=True, return_inverse=True)
    first, held = np.full(len(c), np.iinfo(np.int64).max), np.zeros(len(c), np.int64)
    np.minimum.at(first, back, table["first"].to_numpy())
    np.add.at(held, back, table["held"].to_numpy())
    text = table["content"].take(pa.array(at)).combine_chunks()
    raw, start = W.bytes_of(text)
    begin, end, word = W.spans(raw, start)
    size = np.diff(word)
    coded = W.binaries(*W.cut_out(raw, begin, end)).dictionary_encode()
    # each piece with a separator behind it
    piece = np.repeat(np.arange(len(c)), size + 1)
    symbols = np.zeros(len(piece), np.int64)
    inner = np.ones(len(piece), bool)
    inner[np.cumsum(size + 1) - 1] = False
    symbols[inner] = coded.indices.to_numpy() + 1
    index = FMIndex(symbols, len(coded.dictionary) + 1, length)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    last = np.flatnonzero(inner & (offset >= length - 1))
    n, lo, hi = index.matching_statistics(symbols, last, length, alone=True)
    best = first[piece[last]]
    several = n >= length
    best[several] = np.minimum(best[several], least_in(first[piece[index.place]], lo[several], hi[several]))
    own, where = piece[last], offset[last] - (length - 1)
    worth = (best < first[own]) | (held[own] > 1)
    own, where, best = own[worth], where[worth], best[worth]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (best[1:] != best[:-1]) | (where[1:] != where[:-1] + 1)])) if len(own) else np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays([pa.array(where[new], pa.int32()), pa.array(np.diff(np.append(new, len(own))), pa.int32()), pa.array(best[new])], ["at", "n", "first"])
    some = np.unique(own)
    lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(own[new], some), len(new)).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([pa.array(c[some]), pa.array(held[some]), lists], ["c", "held", "spans"])


def repeated_windows(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """(r, spans): of the rows (doc_id, text, r) that lose windows, stretches (start, n) of such windows, by their first words."""
    spark = rows.sparkSession
    anchors = written(shared_anchors(rows, length, anchor), "anchors")
    total = anchors.agg(F.sum("held")).first()[0] or 0
    hot = np.array([r[0] for r in anchors.filter(F.col("held") > max(LEAST_HOT, total // HOT)).select("h").collect()], np.int64).view(np.uint64)
    known = spark.sparkContext.broadcast((bitmap(anchors), hot))
    dropped(anchors)

    def chosen(batch: pa.RecordBatch) -> tuple[Pieces, np.ndarray]:
        p = Pieces(batch.column(1), length, anchor)
        bits, often = known.value
        p.taken(set_bits(bits, p.anchor))
        return p, p.by_window(often)

    def contents(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, key = chosen(batch)
        doc = batch.column(0).to_numpy()[p.text]
        c, at, back, n = np.unique(p.content(), return_index=True, return_inverse=True, return_counts=True)
        first = np.full(len(c), np.iinfo(np.int64).max)
        np.minimum.at(first, back, doc)
        return pa.RecordBatch.from_arrays([signed(key[at]), signed(c), p.texts(at, length), pa.array(first), pa.array(n, pa.int64())], ["key", "c", "content", "first", "held"])

    def holders(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, _ = chosen(batch)
        at = (p.at - p.first[p.text]).astype(np.int32)
        return pa.RecordBatch.from_arrays([signed(p.content()), batch.column(2).take(pa.array(p.text)), batch.column(0).take(pa.array(p.text)), pa.array(at)], ["c", "r", "doc_id", "at"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield earliest(held, length)

    shards = max(1, -(-total * (length + 4) // SHARD))
    dealt = rows.select("doc_id", "text").mapInArrow(by_batches(contents), "key bigint, c bigint, content string, first bigint, held bigint").repartition(shards, "key")
    spans = written(dealt.select("c", "content", "first", "held").mapInArrow(shard, f"c bigint, held bigint, spans {SPANS}"), "spans")
    held = written(rows.select("doc_id", "text", "r").mapInArrow(by_batches(holders), "c bigint, r bigint, doc_id bigint, at int"), "holders")
    met = looked_up(held, spans, "c", "held", total)
    lost = met.select("r", "doc_id", "at", F.explode("spans").alias("s")).filter("s.first < doc_id")
    return lost.groupBy("r").agg(F.collect_set(F.struct((F.col("at") + F.col("s.at")).alias("start"), F.col("s.n").alias("n"))).alias("spans"))


def without_repeated_passages(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row of ``docs`` (doc_id, text), whose other columns play no part.

    Words are what white space (\\x20, \\x09 to \\x0D) sets apart; ``kept`` joins by one space those that no window of ``length`` words covers
    which a document of a smaller doc_id holds. Rows of one doc_id take nothing from each other. A null or empty text has no words;
    a text with fewer words than a window, and a row with a null doc_id, loses nothing, and the latter takes nothing from others. Repeated
    rows stay, each with its result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("r", F.xxhash64("doc_id", "text"))
    found = repeated_windows(rows.filter("doc_id is not null and text is not null"), length, anchor)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, start = W.bytes_of(batch.column(1))
        begin, end, first = W.spans(raw, start)
        spans = batch.column(2)
        inside = np.zeros(len(begin) + 1, np.int64)
        size = np.diff(spans.offsets.to_numpy())
        flat = spans.flatten()
        at = flat.field("start").to_numpy() + np.repeat(first[:-1], size)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + flat.field("n").to_numpy() + length - 1, -1)
        keep = np.cumsum(inside[:-1]) == 0
        past = np.concatenate([[0], np.cumsum(keep)])[first]
        n = np.diff(first)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(n - np.diff(past)), joined(raw, begin[keep], end[keep], past)], ["doc_id", "n_words", "n_removed", "kept"])

    none = F.array().cast("array<struct<start:int,n:int>>")
    met = rows.join(found, "r", "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    return met.mapInArrow(by_batches(cut, 2_000_000), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


#: The query's rows in DuckDB: all windows, as texts, with the smallest doc_id that holds each.
SQL = r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (SELECT row, doc_id, i, list_aggregate(words[i : i + 12], 'string_agg', ' ') AS t FROM (SELECT row, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)),
f AS (SELECT t, min(doc_id) AS first FROM w GROUP BY 1),
l AS (SELECT row, list(DISTINCT i) AS gone FROM (SELECT row, unnest(range(i, i + 13)) AS i FROM w JOIN f USING (t) WHERE first < doc_id) GROUP BY 1),
k AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d) u ANTI JOIN (SELECT row, unnest(gone) AS i FROM l) x USING (row, i) GROUP BY 1)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (row)"""
