"""Token ids in binary shards of fixed-width bit packing.

A shard holds the ids of a range of documents in ascending doc_id order. Each id takes the fewest bits that the vocabulary
needs. Ids come in blocks of :data:`BLOCK`, each padded to whole bytes, so every block but the last has the same length and
block k starts at a known offset: any run of documents is read by one range read and unpacked with numpy.

Shard layout, little-endian: header ``magic, version, bits, block, n_ids, n_docs`` (:data:`HEADER`), the packed blocks, then
for each document its doc_id (int64), whether it is null (uint8) and the start of its ids in the shard (int64).

Tasks write shards with ``pyarrow.fs`` under a name of their own attempt and move them to the final name when complete, so a
repeated task replaces its shard with the same bytes.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergestone.llm import word_table as W
from mergestone.llm.shared import shared_dir, written

BLOCK = 8192
HEADER = struct.Struct("<8sIIQQQ")
MAGIC = b"TOKNIDS1"
END_ID = 1
#: Ids after which a task begins its next shard, so that no shard grows with the table.
SHARD = 1 << 25


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Bit k of id i is bit i * bits + k of the result, lowest first, padded to a whole byte."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flat = np.zeros((n, 32), np.uint8)
    flat[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return np.packbits(flat, axis=1, bitorder="little").view("<u4").ravel()


def _plain(word: bytes) -> bool:
    """Letters that the normaliser leaves as they are."""
    text = word.decode("utf8")
    return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)


@lru_cache(1)
def encoder_of(path: str) -> WordEncoder:
    """One a Python worker, so that its tasks share what it remembers."""
    return WordEncoder(path)


SMALL = np.zeros(256, bool)
SMALL[97:123] = True
#: ASCII signs: at the end of a word, after a letter, they are a word of their own to the pre-tokenizer.
SIGN = np.zeros(256, bool)
SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class WordEncoder:
    """Encodes texts with a word-level BPE of the tokenizers library.

    Its pre-tokenizer never joins characters across white space, so the ids of a text are those of its words, and each
    distinct word needs the library only once. Words are looked up many at a time; those that are new are cut into letters and
    signs behind them, and of these again only new ones are encoded. A text that holds an added token, which the library looks
    for before it lower-cases anything, goes to the library as a whole.
    """

    #: Words remembered at a time; the memory starts anew beyond it, which changes no result.
    KEEP = 2_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # the same vocabulary and merges for words that the normaliser leaves as they are and the pre-tokenizer doesn't cut
        plain = json.loads(self.library.to_str())
        byte_level = next(p for p in plain["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel")
        self.added = [t["content"].encode("utf8") for t in plain["added_tokens"]]
        plain |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.vocabulary = self.library.get_vocab_size()
        self.ends = np.zeros(self.vocabulary, bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.words, self.parts = W.Numbers(), W.Numbers()
        self.ids, self.part_ids = W.Runs(np.uint32), W.Runs(np.uint32)

    def forget(self) -> None:
        for memory in (self.words, self.parts, self.ids, self.part_ids):
            memory.clear()

    def learn(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Words that are not known yet, in their order."""
        stop, some = end.copy(), np.arange(len(end))
        for _ in range(W.SIDE_BY_SIDE):
            some = some[SIGN[raw[stop[some] - 1]]]
            if not len(some):
                break
            stop[some] -= 1
            some = some[stop[some] > begin[some]]
        odd = np.concatenate([np.zeros(1, np.int64), np.cumsum(~SMALL[raw])])
        plain = (stop > begin) & (odd[stop] == odd[begin])
        for i in np.flatnonzero(~plain & (stop > begin)).tolist():
            plain[i] = _plain(raw[begin[i] : stop[i]].tobytes())
        stop = np.where(plain, stop, end)  # other words go to the library as they are
        tail = np.flatnonzero(stop < end)
        lo, hi = np.concatenate([begin, stop[tail]]), np.concatenate([stop, end[tail]])
        easy = np.concatenate([plain, np.ones(len(tail), bool)])
        number, new = self.parts.found(W.keys(raw, lo, hi))
        if len(new):
            self.encode_parts([raw[lo[i] : hi[i]].tobytes().decode("utf8") for i in new.tolist()], easy[new])
        pair = np.full((len(begin), 2), -1, np.int64)
        pair[:, 0] = number[: len(begin)]
        pair[tail, 1] = number[len(begin) :]
        flat = pair.ravel()
        at = np.flatnonzero(flat >= 0)
        values, past = self.part_ids.take(flat[at])
        size = np.bincount(at // 2, np.diff(past, prepend=0), len(begin)).astype(np.int64)
        self.ids.add(values, size)

    def encode_parts(self, parts: list[str], easy: np.ndarray) -> None:
        which = np.flatnonzero(easy)
        got = np.array(self.plain.encode(" ".join([parts[i] for i in which.tolist()]), add_special_tokens=False).ids, np.uint32)
        size = np.diff(np.flatnonzero(self.ends[got]) + 1, prepend=0)
        if len(size) != len(which) or size.sum() != len(got):  # a word ended otherwise than it should: each by itself
            which, got, size = which[:0], got[:0], size[:0]
        rest = np.setdiff1d(np.arange(len(parts)), which)
        more = [np.array(e.ids, np.uint32) for e in self.library.encode_batch([parts[i] for i in rest.tolist()], add_special_tokens=False)]
        made = W.Runs(np.uint32)
        made.add(got, size)
        made.add(np.concatenate([got[:0], *more]), np.array([len(m) for m in more], np.int64))
        place = np.empty(len(parts), np.int64)
        place[np.concatenate([which, rest])] = np.arange(len(parts))
        values, end = made.take(place)
        self.part_ids.add(values, np.diff(end, prepend=0))

    def encode(self, texts: pa.Array | Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each whole text; a null is an empty text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list[np.ndarray] = []
        for a, b in W.pieces_of(column):
            raw, start = W.bytes_of(column.slice(a, b - a))
            whole = raw.tobytes() if any(raw.tobytes().find(t) >= 0 for t in self.added) else b""
            if len(self.words) > self.KEEP:
                self.forget()
            raw = W.LOWER[raw]
            begin, end, first = W.spans(raw, start)
            number, new = self.words.found(W.keys(raw, begin, end))
            if len(new):
                self.learn(raw, begin[new], end[new])
            flat, past = self.ids.take(number)
            ids = np.split(flat, W.ends_of(past, first)[:-1])
            if whole:
                for i, (lo, hi) in enumerate(zip(start.tolist(), start[1:].tolist())):
                    if any(whole.find(t, lo, hi) >= 0 for t in self.added):
                        ids[i] = np.array(self.library.encode(whole[lo:hi].decode("utf8"), add_special_tokens=False).ids, np.uint32)
            out += ids
        return out


class ShardWriter:
    def __init__(self, out, bits: int):
        self.out, self.bits, self.n_ids, self.doc_ids, self.starts, self.rest = out, bits, 0, [], [], []
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 16 * BLOCK:
            self.flush(self.waiting // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.rest])
        for lo in range(0, n, BLOCK):
            self.out.write(pack(ids[lo : min(lo + BLOCK, n)], self.bits))
        self.rest, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self.flush(self.waiting)
        self.out.write(np.array([x or 0 for x in self.doc_ids], "<i8").tobytes())
        self.out.write(np.array([x is None for x in self.doc_ids], np.uint8).tobytes())
        self.out.write(np.array(self.starts, "<i8").tobytes())
        self.out.write(HEADER.pack(MAGIC, 1, self.bits, BLOCK, self.n_ids, len(self.doc_ids)))


def read_range(f, lo: int, hi: int) -> tuple[list[int | None], np.ndarray, list[np.ndarray]]:
    """Of an open shard, the documents ``lo`` to ``hi``: doc_ids, starts in the shard, ids."""
    size = f.size()
    f.seek(size - HEADER.size)
    magic, _, bits, block, n_ids, n_docs = HEADER.unpack(f.read(HEADER.size))
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    hi = min(hi, n_docs)
    at = size - HEADER.size - 17 * n_docs

    def table(kind: str, start: int, a: int, b: int) -> np.ndarray:
        n = np.dtype(kind).itemsize
        f.seek(start + a * n)
        return np.frombuffer(f.read((b - a) * n), kind)

    doc_ids, null = table("<i8", at, lo, hi), table("u1", at + 8 * n_docs, lo, hi)
    starts = table("<i8", at + 9 * n_docs, lo, min(hi + 1, n_docs))
    ends = np.r_[starts[1:], n_ids] if hi == n_docs else starts[1:]
    starts = starts[: hi - lo]
    first, last = int(starts[0]) // block, -(-int(ends[-1]) // block)
    each = -(-block * bits // 8)
    f.seek(first * each)
    n = min(last * block, n_ids) - first * block
    data = f.read((last - first - 1) * each + -(-(n - (last - first - 1) * block) * bits // 8)) if n else b""
    if block * bits % 8 == 0:
        ids = unpack(data, n, bits)
    else:
        ids = np.concatenate([unpack(data[k * each : (k + 1) * each], min(block, n - k * block), bits) for k in range(last - first)])
    return [None if x else int(d) for d, x in zip(doc_ids, null)], starts, [ids[a - first * block : b - first * block] for a, b in zip(starts, ends)]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, shard_ids: int = SHARD) -> DataFrame:
    """Encodes whole texts, appends id 1 to each document, and writes shards in ascending doc_id order.

    Returns one row (shard, path, n_docs, n_ids, first) for each shard; first counts the ids of all shards before it. A task
    begins another shard after ``shard_ids`` ids. A null text is an empty one; null doc_ids come first; equal doc_ids are
    ordered by text; a text of any length is encoded as a whole. An empty table has no shard. Extra columns are not read.
    """
    folder = folder or f"{shared_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        to, place = fs.FileSystem.from_uri(folder)
        to.create_dir(place, recursive=True)
        encoder, writer, out, name, number = None, None, None, "", 0

        def done() -> pa.RecordBatch:
            writer.close()
            out.close()
            to.move(f"{place}/{name}.{task.taskAttemptId()}", f"{place}/{name}")
            return pa.RecordBatch.from_pydict({"shard": [task.partitionId() << 24 | number], "path": [f"{folder}/{name}"], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids]})

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                encoder = encoder or encoder_of(tokenizer)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                    if writer is not None and writer.n_ids >= shard_ids:
                        yield done()
                        writer, number = None, number + 1
                    if writer is None:
                        name = f"shard-{task.partitionId():06d}-{number:06d}.tok"
                        out = to.open_output_stream(f"{place}/{name}.{task.taskAttemptId()}")
                        writer = ShardWriter(out, width(encoder.vocabulary))
                    writer.add(doc_id, np.append(ids, np.uint32(END_ID)))
        if writer is not None:
            yield done()

    shards = written(rows.mapInArrow(run, "shard long, path string, n_docs long, n_ids long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return shards.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(shards: DataFrame, digest: bool = False, run_of: int = 512) -> DataFrame:
    """Reads shards back, ``run_of`` documents a range read: one row (doc_id, start, ids) for each document, or with
    ``digest`` (doc_id, start, n_tokens, ids_crc32), for which the ids need not leave the task that has read them."""
    runs = shards.select("path", "first", F.explode(F.expr(f"sequence(0L, n_docs - 1, {run_of}L)")).alias("lo"))
    runs = runs.repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                at, place = fs.FileSystem.from_uri(x["path"])
                with at.open_input_file(place) as f:
                    doc_ids, starts, ids = read_range(f, x["lo"], x["lo"] + run_of)
                out = {"doc_id": pa.array(doc_ids, pa.int64()), "start": starts + x["first"]}
                if digest:
                    out["n_tokens"] = pa.array([len(i) for i in ids], pa.int64())
                    out["ids_crc32"] = pa.array([zlib.crc32(np.ascontiguousarray(i, "<u4")) for i in ids], pa.int64())
                else:
                    out["ids"] = pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return runs.mapInArrow(run, "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids array<int>"))
