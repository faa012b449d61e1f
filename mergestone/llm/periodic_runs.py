"""Maximal runs of words that repeat with a period, and texts with each run cut down to its first period.

A run is a stretch of words with smallest period q that holds at least :data:`EXPONENT` periods and :data:`LEAST` words and that no
neighbouring word extends. They are found with string synchronising sets:

* Words get exact names, and so do stretches of 2, 4, 8, ... words, by the pair of names of their halves. A name that a text
  holds once plays no further part: every stretch of up to 3q words inside a run comes again q words later.
* Periods below :data:`SMALL` are detected by themselves, by comparing words that far apart.
* At scale t = 8, 16, 32, ... a position is in the synchronising set if, of the names of length t that begin at it or at the t
  positions after it, the least by a hash is the first or the last. That depends on 2t words only, so in a run the set repeats
  with the run's period. Names with a period of at most t / 4 are left out, so that the set stays sparse in highly periodic
  regions; the runs of those periods are known from smaller scales.
* Two neighbouring positions of the set with the same context of 2t words propose their distance, if it is from t to 2t, as a
  period. Runs of these periods have a position in their first period, whose context comes again within the run, so none is
  missed; each proposal is extended word by word to a maximal run and kept if it is long enough.

Spark: each text is looked through by itself, so there is no shuffle. Many texts are looked through at once; memory is a few numbers a word
of about 2 MB of text, or of the one text that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.llm import word_table as W

#: Least length of a run in periods and in words.
EXPONENT, LEAST = 4, 6
#: Periods below this are found by comparing all words of that distance.
SMALL = 8
FAR = np.uint64(2**64 - 1)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, whether others have the same key)."""
    order = np.argsort(key, kind="stable")
    own = key[order]
    new = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    held = np.bincount(number) if len(key) else np.zeros(0, np.int64)
    return number, held[number] > 1


def windows_min(value: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` neighbouring values, by doubling."""
    out, have = value, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def extended(word: np.ndarray, at: int, period: int, first: int, end: int) -> tuple[int, int]:
    """The maximal stretch of this period around ``at``, where it holds, of a text from ``first`` to ``end``."""
    lo, step = at, 32
    while lo > first:
        step = min(2 * step, lo - first)
        odd = np.flatnonzero(word[lo - step : lo] != word[lo - step + period : lo + period])
        if len(odd):
            lo += int(odd[-1]) + 1 - step
            break
        lo -= step
    hi, step = at, 32
    while hi < end - period:
        step = min(2 * step, end - period - hi)
        odd = np.flatnonzero(word[hi : hi + step] != word[hi + period : hi + period + step])
        if len(odd):
            hi += int(odd[0])
            break
        hi += step
    return lo, hi + period


def find(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (text, start, end, period) of all runs, by text, start and period; ``word`` numbers the words of texts end to end, and
    ``first`` has where each text begins, and the end. Starts and ends are places in ``word``."""
    n, size = len(word), np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    found = [np.zeros((0, 4), np.int64)]
    for q in range(1, min(SMALL, n)):
        lo, hi = stretches((word[:-q] == word[q:]) & (text[:-q] == text[q:]))
        long = hi - lo >= (EXPONENT - 1) * q
        lo, hi = lo[long], hi[long] + q
        found.append(np.stack([text[lo], lo, hi, np.full(len(lo), q)], axis=1))
    at = np.arange(n)
    name, more = repeated(text * np.int64(int(word.max(initial=0)) + 1) + word)
    at, name, length = at[more], name[more], 1
    while len(at):
        dense = np.full(n + length, -1, np.int64)
        dense[at] = name
        pair = dense[at + length]
        both = pair >= 0
        wide, more = repeated(name[both] * np.int64(n + 1) + pair[both])
        context_at, context = at[both][more], wide[more]
        if length >= SMALL and len(context_at):
            found.append(proposed(word, text, first, found, at, name, context_at, context, length))
        at, name, length = context_at, context, 2 * length
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1]))]
    runs = runs[np.concatenate([[True], (runs[1:, 1:3] != runs[:-1, 1:3]).any(axis=1)])] if len(runs) else runs
    runs = runs[runs[:, 2] - runs[:, 1] >= np.maximum(LEAST, EXPONENT * runs[:, 3])]
    return runs[np.lexsort((runs[:, 3], runs[:, 1]))]


def synchronising(n: int, at: np.ndarray, name: np.ndarray, omitted: np.ndarray, scale: int) -> np.ndarray:
    """Whether each of ``n`` positions is in the synchronising set of this scale. ``omitted``: rows of runs whose periods are small here."""
    value = np.full(n + scale + 1, FAR)
    value[at] = W.mixed(name.astype(np.uint64))
    if len(omitted):
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, omitted[:, 1], 1)
        np.add.at(inside, omitted[:, 2] - scale + 1, -1)
        value[:n][np.cumsum(inside[:n]) > 0] = FAR
    least = windows_min(value, scale + 1)[:n]
    return (least < FAR) & ((value[:n] == least) | (value[scale : scale + n] == least))


def proposed(word, text, first, found, at, name, context_at, context, scale) -> np.ndarray:
    """Runs with periods from ``scale`` to less than twice that."""
    known = np.concatenate(found)
    omitted = known[(4 * known[:, 3] <= scale) & (known[:, 2] - known[:, 1] >= scale)]
    chosen = synchronising(len(word), at, name, omitted, scale)[context_at]
    place, own = context_at[chosen], context[chosen]
    order = np.argsort(own, kind="stable")  # places ascend, and do within a context
    place, own = place[order], own[order]
    gap = place[1:] - place[:-1]
    good = np.flatnonzero((own[1:] == own[:-1]) & (gap >= scale) & (gap < 2 * scale))
    pairs = np.stack([gap[good], place[good]], axis=1)
    out, done, last = [], -1, -1
    for q, i in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
        if q == last and i + q < done:
            continue  # inside the run just found
        k = int(text[i])
        lo, done = extended(word, i, q, int(first[k]), int(first[k + 1]))
        last = q
        if done - lo >= EXPONENT * q:
            out.append((k, lo, done, q))
    return np.array(out, np.int64).reshape(-1, 4)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word is outside all runs, or in the first period of each run that holds it."""
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, runs[:, 1] + runs[:, 3], 1)
    np.add.at(inside, runs[:, 2], -1)
    return np.cumsum(inside[:n]) == 0


def joined(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts of words, joined by one space; ``first`` has the number of each text's first word, and of all words."""
    size = np.diff(first)
    inner = np.ones(len(begin), bool)
    inner[(first[1:] - 1)[size > 0]] = False
    data, length = W.cut_out(raw, begin, end + inner)
    data[(np.cumsum(length) - 1)[inner]] = 32
    start = np.concatenate([[0], np.cumsum(length)])[first].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(start), pa.py_buffer(np.ascontiguousarray(data))])


def collapsed_texts(column: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(number of words, runs, text with each run cut down to its first period) of a column of texts."""
    raw, start = W.bytes_of(column)
    begin, end, first = W.spans(raw, start)
    word = W.binaries(*W.cut_out(raw, begin, end)).dictionary_encode().indices.to_numpy() if len(begin) else np.zeros(0, np.int64)
    runs = find(word.astype(np.int64), first)
    keep = kept_words(len(word), runs)
    past = np.concatenate([[0], np.cumsum(keep)])[first]
    values = pa.StructArray.from_arrays([pa.array(runs[:, 1] - first[runs[:, 0]]), pa.array(runs[:, 2] - runs[:, 1]), pa.array(runs[:, 3])], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(runs[:, 0], np.arange(len(column) + 1)).astype(np.int32)), values)
    return np.diff(first), lists, joined(raw, begin[keep], end[keep], past)


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of ``docs`` (doc_id, text), whose other columns play no part.

    ``runs`` are (start, length, period) in words, by start and period; ``collapsed`` is the text's words, joined by one space, without
    those that a run holds after its first period. Words are what white space (\\x20, \\x09 to \\x0D) sets apart, compared byte by
    byte. Nulls and empty texts have no words, no runs and an empty text; repeated rows stay, each with its result.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in W.pieces_of(batch.column(1)):
                n, runs, text = collapsed_texts(batch.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), runs, text], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(look, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where every tenth document or so, by crc32 of its id, repeats one stretch of its words to its end. Rows with a null id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), g.alias("g"))
    n = F.size("w")
    some = some.select("doc_id", "text", "w", "g", n.alias("n"), F.when(n > 0, F.col("g") % n).cast("int").alias("a"))
    some = some.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    again = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """A row a document with its longest run (ties: the smallest start, then period) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("b.length * 1000 div -b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
