"""SentencePiece encoding and decoding by a max-plus parallel scan.

A sequence of pieces is the encoding of its text by byte-pair merges exactly if every two neighbours, merged by themselves,
stay as they are: merges inside a piece and across a boundary depend on nothing farther off. So encoding is a path in max-plus
algebra whose states are pieces and whose step from one piece to the next weighs 0 if the two may stand together and minus
infinity otherwise. The encoding is the one path of finite weight.

Giant texts are split into chunks. A chunk's matrix has the pieces that may cross its first boundary as rows and those that
may cross its last one as columns; an entry is finite if a path joins the two. Tasks make these matrices independently. Spark
multiplies them in a tree: products of :data:`FAN` neighbours, then products of those, up to one matrix a document; on the way
down each product hands the pieces at its own ends to its factors, which so learn the pieces at theirs. No task holds more than
:data:`FAN` matrices of a document. Then tasks trace each chunk back from its boundary pieces, by itself. Inside a chunk no
piece reaches across the start of a word, so all that is between the first and last word start is encoded word by word, each
distinct word once. A shorter text is one chunk, whose boundaries are the ends of the text.

The vocabulary, its scores and its byte pieces come from a SentencePiece model file; the ids equal that library's.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.llm import word_table as W
from mergestone.llm.shared import written

SPACE = "▁"
CHUNK = 32_768
#: Matrices that are multiplied in one task.
FAN = 8
KEEP = 600_000
#: Segments remembered at a time; the memory starts anew beyond it, which changes no result. A worker keeps it from task to task, so
#: it must be small beside an executor's memory however many tasks there are.
REMEMBER = 400_000
SIGNS = np.zeros(256, bool)
SIGNS[list(b".,;:!?*$)\"#%&")] = True


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.longest = max(map(len, self.id))
        self.spelt = W.Runs(np.uint8)  # the bytes of each id
        spelt = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.spelt.add(np.frombuffer(b"".join(spelt), np.uint8), np.array(list(map(len, spelt)), np.int64))
        crossing = [p for p in self.id if re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p]
        if crossing:
            raise ValueError("pieces reach across the start of a word")
        self.side_by_side = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.spelling = list(self.id)
        self.number = {p: k for k, p in enumerate(self.spelling)}
        self.found = ahocorasick.Automaton()
        for p, k in self.number.items():
            self.found.add_word(p, (len(p), k))
        self.found.make_automaton()
        self.letters = {p for p in self.id if len(p) == 1}
        self.next_to: dict[int, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.segments, self.parts = W.Numbers(), W.Numbers()
        self.ids, self.part_ids = W.Runs(np.int32), W.Runs(np.int32)

    # ------------------------------------------------------------------------------------------------- pieces and pairs

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges of a short text: always the best score, the leftmost of equals."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: str, b: str) -> bool:
        key = (a, b)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > KEEP:
                self.pairs.clear()
            got = self.pairs[key] = self.merged(a + b) == [a, b]
        return got

    def is_piece(self, p: str) -> bool:
        """A single character is one even if it has no id: it is then written as bytes."""
        if len(p) == 1:
            return True
        got = self.alone.get(p)
        if got is None:
            got = self.alone[p] = p in self.id and self.merged(p) == [p]
        return got

    # ------------------------------------------------------------------------------------------------------------ paths

    def forward(self, text: str, lo: int, hi: int, before: str = "") -> list[int]:
        """For each end in lo..hi the start of the last piece of the one path from ``lo``, where the piece ``before`` ended,
        to that end; -1 where no path does."""
        last = [-1] * (hi - lo + 1)
        last[0] = lo
        ids, longest = self.id, self.longest
        for end in range(lo + 1, hi + 1):
            for start in range(max(lo, end - longest), end):
                if last[start - lo] < 0:
                    continue
                p = text[start:end]
                if end - start > 1 and (p not in ids or not self.is_piece(p)):
                    continue
                prev = before if start == lo else text[last[start - lo] : start]
                if not prev or self.may_follow(prev, p):
                    last[end - lo] = start
                    break
        return last

    def back(self, text: str, last: list[int], lo: int, end: int) -> list[str]:
        out = []
        while end > lo:
            start = last[end - lo]
            out.append(text[start:end])
            end = start
        return out[::-1]

    def numbers(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.id.get(p)
            if i is None:
                out += [self.byte[b] for b in p.encode("utf8", "replace")]
            else:
                out.append(i)
        return out

    def whole(self, segment: str) -> list[int]:
        return self.numbers(self.back(segment, self.forward(segment, 0, len(segment)), 0, len(segment)))

    def many(self, segments: list[str]) -> list[list[int]]:
        """Ids of many segments in one pass over all places where pieces end: the same path as :meth:`forward` finds."""
        text = "\n".join(segments)  # no piece holds a line end
        start = np.cumsum([0, *(len(s) + 1 for s in segments)]).tolist()
        begin, n = len(self.spelling), len(self.spelling) + 1
        last, back = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        for s in start[:-1]:
            last[s] = begin
        next_to, spelling = self.next_to, self.spelling
        if len(next_to) > 4 * KEEP:
            next_to.clear()
        for end, (size, k) in self.found.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            a = last[end - size]
            if a < 0:
                continue
            key = a * n + k
            good = next_to.get(key)
            if good is None:
                good = next_to[key] = self.is_piece(spelling[k]) if a == begin else self.merged(spelling[a] + spelling[k]) == [spelling[a], spelling[k]]
            if good:
                last[end], back[end] = k, end - size
        ids, out = self.id, []
        for s, segment in zip(start, segments):
            at, own = s + len(segment), []
            if last[at] < 0:  # characters outside the vocabulary
                out.append(self.whole(segment))
                continue
            while at > s:
                own.append(ids[spelling[last[at]]])
                at = back[at]
            out.append(own[::-1])
        return out

    def learn(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Segments that are not known yet, in their order. Signs at the end of a word that no piece joins to its last letter are
        a segment of their own, and only parts that are new are traced."""
        stop, some = end.copy(), np.arange(len(end))
        for _ in range(W.SIDE_BY_SIDE):
            some = some[SIGNS[raw[stop[some] - 1]]]
            if not len(some):
                break
            stop[some] -= 1
            some = some[stop[some] > begin[some]]
        tail = np.flatnonzero((stop < end) & (stop > begin))
        joins = [self.joins(raw, int(stop[i])) for i in tail.tolist()]
        tail = tail[~np.array(joins, bool)]
        past = end.copy()
        past[tail] = stop[tail]
        lo, hi = np.concatenate([begin, past[tail]]), np.concatenate([past, end[tail]])
        number, new = self.parts.found(W.keys(raw, lo, hi))
        if len(new):
            made = self.many([raw[lo[i] : hi[i]].tobytes().decode("utf8").replace(" ", SPACE) for i in new.tolist()])
            size = np.array(list(map(len, made)), np.int64)
            self.part_ids.add(np.fromiter((i for m in made for i in m), np.int32, int(size.sum())), size)
        pair = np.full((len(begin), 2), -1, np.int64)
        pair[:, 0] = number[: len(begin)]
        pair[tail, 1] = number[len(begin) :]
        at = np.flatnonzero(pair.ravel() >= 0)
        values, ends = self.part_ids.take(pair.ravel()[at])
        self.ids.add(values, np.bincount(at // 2, np.diff(ends, prepend=0), len(begin)).astype(np.int64))

    def joins(self, raw: np.ndarray, at: int) -> bool:
        """Does some piece hold the characters before and behind ``at`` side by side?"""
        lo = at - 1
        while raw[lo] & 0xC0 == 0x80:
            lo -= 1
        return raw[lo : at + 1].tobytes().decode("utf8").replace(" ", SPACE) in self.side_by_side

    def words(self, text: str) -> np.ndarray:
        """Ids of a text that begins and ends where no piece can cross."""
        data = text.replace(SPACE, " ").encode("utf8", "replace")
        return self.encoded(np.frombuffer(data + bytes(8), np.uint8), np.array([0, len(data)]))[0]

    def encoded(self, raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end) of texts, end to end, as :func:`W.bytes_of` gives them, with a space for each U+2581. Segments begin at
        line ends, behind them, and at the first of some spaces, which belong to the word behind them."""
        n = int(start[-1])
        if len(self.segments) > REMEMBER:
            self.forget()
        line, space = raw[:n] == 10, raw[:n] == 32
        new = line | space
        new[1:] &= ~(space[1:] & space[:-1])
        new[1:] |= line[:-1]
        new[start[:-1][start[:-1] < n]] = True
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], n)
        number, fresh = self.segments.found(W.keys(raw, begin, end))
        if len(fresh):
            self.learn(raw, begin[fresh], end[fresh])
        ids, past = self.ids.take(number)
        return ids, W.ends_of(past, np.searchsorted(begin, start))

    # ----------------------------------------------------------------------------------------------------------- chunks

    def crossing(self, text: str, at: int) -> list[tuple[int, int]]:
        """Spans of the pieces that may be the last to start before ``at`` and reach it."""
        lo, hi = max(0, at - self.longest), min(len(text), at + self.longest)
        return [(s, e) for s in range(lo, at) for e in range(at, min(hi, s + self.longest) + 1) if e - s == 1 or text[s:e] in self.id and self.is_piece(text[s:e])]

    def cuts(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """First and last place from lo to hi that no piece crosses, whatever stands around."""
        places = re.compile(f"(?<=[^{SPACE}])(?={SPACE})|(?<=\n)|(?=\n)")
        first = places.search(text, lo, hi)
        if first is None or first.start() > hi:
            return None
        step = 1024
        last = first.start()
        at = hi
        while at > last:
            found = [m.start() for m in places.finditer(text, max(last, at - step), hi)]
            if found:
                return first.start(), max(found)
            at -= step
        return last, last

    def matrix(self, text: str, lo: int, hi: int, first: bool, final: bool) -> list[tuple[int, int, int, int]]:
        """Finite entries (start, end of the piece over ``lo``; start, end of the piece over ``hi``) of a chunk of ``text``;
        at the start and the end of the document there is one state, written (lo, lo) and (hi, hi)."""
        enter = [(lo, lo)] if first else self.crossing(text, lo)
        leave = [(hi, hi)] if final else self.crossing(text, hi)
        far = max(e for _, e in leave)
        cut = self.cuts(text, min(len(text), lo + 2 * self.longest), max(0, hi - 2 * self.longest)) if hi - lo > 8 * self.longest else None

        def exits(last: list[int], base: int) -> list[tuple[int, int]]:
            if final:
                return [(hi, hi)] if hi >= base and last[hi - base] >= 0 else []
            return [(s, e) for s, e in leave if e - base >= 0 and s >= base and last[e - base] == s]

        out = []
        if cut is not None:
            after = exits(self.forward(text, cut[1], far), cut[1])
            for s, e in enter:
                if e <= cut[0] and self.forward(text, e, cut[0], text[s:e])[-1] >= 0:
                    out += [(s, e, *x) for x in after]
            return out
        for s, e in enter:
            if e > hi or e == hi and not final:  # the same piece lies over both boundaries
                out += [(s, e, s, e)] if (s, e) in leave or final and e == hi else []
                continue
            out += [(s, e, *x) for x in exits(self.forward(text, e, far, text[s:e]), e)]
        return out

    def traced(self, text: str, lo: int, hi: int, enter: tuple[int, int], leave: tuple[int, int], final: bool) -> np.ndarray:
        """Ids of the pieces that start in a chunk, given those over its boundaries."""
        begin, end = enter[1], hi if final else leave[1]
        if begin >= end:
            return np.zeros(0, np.int32)
        cut = self.cuts(text, min(len(text), lo + 2 * self.longest), max(0, hi - 2 * self.longest)) if hi - lo > 8 * self.longest else None
        if cut is None or not begin <= cut[0] <= cut[1] <= end:
            return np.array(self.numbers(self.back(text, self.forward(text, begin, end, text[enter[0] : begin]), begin, end)), np.int32)
        head = self.numbers(self.back(text, self.forward(text, begin, cut[0], text[enter[0] : begin]), begin, cut[0]))
        tail = self.numbers(self.back(text, self.forward(text, cut[1], end), cut[1], end))
        return np.concatenate([np.array(head, np.int32), self.words(text[cut[0] : cut[1]]), np.array(tail, np.int32)])

    # --------------------------------------------------------------------------------------------------------- decoding

    def decode(self, ids: np.ndarray) -> str:
        out = self.spelt.take(ids)[0].tobytes().decode("utf8", "replace")
        return out[1:] if out[:1] == " " else out


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    """One a Python worker, so that its tasks share what it remembers."""
    return Pieces(path)


def normal(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def normal_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts of :func:`normal`, with spaces for U+2581, as :func:`W.bytes_of` gives them."""
    column = column.cast(pa.large_string()).fill_null("")
    if pc.any(pc.match_substring(column, SPACE)).as_py():
        column = pc.replace_substring(column, SPACE, " ")
    behind = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string()))
    return W.bytes_of(pc.if_else(pc.equal(pc.binary_length(column), 0), pa.scalar("", pa.large_string()), behind))


# --------------------------------------------------------------------------------------------- matrices and their products

Entry = tuple[int, int, int, int]


def product(left: set[Entry], right: set[Entry]) -> set[Entry]:
    """Max-plus product: an entry is finite if some piece at the boundary between the two is reached and left."""
    onward: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for e in right:
        onward.setdefault(e[:2], []).append(e[2:])
    return {(*a[:2], *b) for a in left for b in onward.get(a[2:], ())}


def handed_down(factors: list[set[Entry]], whole: Entry) -> list[Entry]:
    """The entry of each factor on the one path whose ends are those of ``whole``."""
    reached = [{whole[:2]}]
    for m in factors:
        reached.append({e[2:] for e in m if e[:2] in reached[-1]})
    out, state = [], whole[2:]
    for k in range(len(factors) - 1, -1, -1):
        out.append(next(e for e in factors[k] if e[2:] == state and e[:2] in reached[k]))
        state = out[-1][:2]
    return out[::-1]


def entries(flat: list[int]) -> set[Entry]:
    return {tuple(flat[i : i + 4]) for i in range(0, len(flat), 4)}


def boundaries(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """(row, k, path): the pieces over both boundaries of each chunk, from (row, k, m) with the entries of each chunk's matrix.

    A tree of grouped products: every group is ``fan`` neighbours of one document, on the way up and down."""
    levels = [written(matrices, "matrices")]
    most = levels[0].agg(F.max("k")).first()[0] or 0

    def multiplied(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda x: x["k"])
        m = reduce(product, [entries(x["m"]) for x in rows])
        return pa.table({"row": t.column("row")[:1], "k": pa.array([rows[0]["k"] // fan], pa.int32()), "m": pa.array([[v for e in sorted(m) for v in e]], pa.list_(pa.int64()))})

    while most:
        up = levels[-1].groupBy("row", F.floor(F.col("k") / fan)).applyInArrow(multiplied, "row long, k int, m array<long>")
        levels.append(written(up, "products"))
        most //= fan

    def handed(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda x: x["k"])
        paths = handed_down([entries(x["m"]) for x in rows], tuple(rows[0]["whole"]))
        return pa.table({"row": t.column("row"), "k": pa.array([x["k"] for x in rows], pa.int32()), "path": pa.array([list(p) for p in paths], pa.list_(pa.int64()))})

    path = levels.pop().select("row", "k", F.slice("m", 1, 4).alias("path"))  # from end to end of a document there is one path
    for level in reversed(levels):
        whole = path.select("row", F.col("k").alias("up"), F.col("path").alias("whole"))
        below = level.withColumn("up", F.floor(F.col("k") / fan).cast("int")).join(whole, ["row", "up"])
        path = written(below.groupBy("row", "up").applyInArrow(handed, "row long, k int, path array<long>"), "paths")
    return path


# ------------------------------------------------------------------------------------------------- checksums of joined parts


def _times(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector, k = vector >> 1, k + 1
    return out


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """crc32 of byte strings end to end, from (crc32, length) of each: adding a zero bit is a linear map over bits of the sum,
    so adding n zero bytes is a power of it."""
    powers = [[0xEDB88320] + [1 << k for k in range(31)]]  # one zero bit
    out = 0
    for crc, length in parts:
        bits, k = length * 8, 0
        while bits:
            if k == len(powers):
                powers.append([_times(powers[-1], c) for c in powers[-1]])
            if bits & 1:
                out = _times(powers[k], out)
            bits, k = bits >> 1, k + 1
        out ^= crc
    return out


# -------------------------------------------------------------------------------------------------------------- operators


def encode_texts(docs: DataFrame, model: str, digest: bool = False, chunk: int = CHUNK) -> DataFrame:
    """One row (doc_id, n_chunks, ids) for each row of ``docs``, or with ``digest`` (doc_id, n_chunks, n_tokens, ids_crc32,
    same): same tells whether the decoded ids are the text again, but for U+2581, which decodes to a space.

    Null and empty texts have no ids. Texts of more than ``chunk`` characters are split, whole, as described above; with
    ``digest`` the chunks of a text are not brought together again. Repeated rows and null doc_ids are encoded each. Extra
    columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.length("text") + 1
    kind = "doc_id long, n_chunks int, " + ("n_tokens long, ids_crc32 long, same boolean" if digest else "ids array<int>")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for batch in batches:
            for lo, hi in W.pieces_of(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                raw, start = normal_bytes(part.column(1))
                ids, end = p.encoded(raw, start)
                out = {"doc_id": part.column(0), "n_chunks": pa.array(np.ones(len(end), np.int32))}
                begin = np.append(0, end[:-1])
                if digest:
                    back, past = p.spelt.take(ids)
                    past = np.append(0, past)[np.append(0, end)]
                    same = np.diff(past) == np.diff(start)
                    if not same.all() or (back != raw[: len(back)]).any():
                        same &= [bool(same[i]) and (back[past[i] : past[i + 1]] == raw[start[i] : start[i + 1]]).all() for i in range(len(end))]
                    data = memoryview(ids.astype("<u4")).cast("B")
                    out |= {"n_tokens": pa.array(end - begin), "ids_crc32": pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist())], pa.int64()), "same": pa.array(same)}
                else:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, end), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_pydict(out)

    few = rows.filter(size <= chunk).mapInArrow(short, kind)
    giant = rows.filter(size > chunk).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    side = 64  # characters of the neighbours that a chunk holds, above twice the longest piece

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass over each text; chunk k begins at character k * chunk, and ``part`` at character ``at``."""
        for batch in batches:
            for i in range(batch.num_rows):
                text = normal(batch.column(2)[i].as_py())
                n = -(-len(text) // chunk)
                at = [max(0, k * chunk - side) for k in range(n)]
                for lo in range(0, n, 64):
                    own = range(lo, min(n, lo + 64))
                    cols = {"doc_id": pa.array([batch.column(0)[i].as_py()] * len(own), pa.int64()), "row": pa.array([batch.column(1)[i].as_py()] * len(own), pa.int64()), "k": pa.array(list(own), pa.int32()), "at": pa.array([at[k] for k in own], pa.int64())}
                    yield pa.RecordBatch.from_pydict(cols | {"end": pa.array([len(text)] * len(own), pa.int64()), "part": pa.array([text[at[k] : (k + 1) * chunk + side] for k in own], pa.string())})

    cut = giant.mapInArrow(cutting, "doc_id long, row long, k int, at long, end long, part string")
    cut = written(cut.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "k"), "chunks")

    def place(x: dict) -> tuple[int, int, bool]:
        final = x["end"] <= (x["k"] + 1) * chunk
        return x["k"] * chunk - x["at"], (x["end"] if final else (x["k"] + 1) * chunk) - x["at"], final

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        if 2 * p.longest > side:
            raise ValueError("a chunk must hold twice the longest piece of its neighbours")
        for batch in batches:
            for x in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                lo, hi, final = place(x)
                m = p.matrix(x["part"], lo, hi, x["k"] == 0, final)
                yield pa.RecordBatch.from_pydict({"row": [x["row"]], "k": pa.array([x["k"]], pa.int32()), "m": pa.array([[v + x["at"] for e in m for v in e]], pa.list_(pa.int64()))})

    paths = boundaries(cut.select("row", "k", "at", "end", "part").mapInArrow(matrices, "row long, k int, m array<long>"))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for batch in batches:
            for x in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                (lo, hi, final), s = place(x), [v - x["at"] for v in x["path"]]
                ids = p.traced(x["part"], lo, hi, (s[0], s[1]), (s[2], s[3]), final)
                out = {"doc_id": pa.array([x["doc_id"]], pa.int64()), "row": [x["row"]], "k": pa.array([x["k"]], pa.int32())}
                if digest:
                    spelt = p.spelt.take(ids)[0].tobytes()
                    own = x["part"][s[1] : max(s[1], hi if final else s[3])].replace(SPACE, " ").encode("utf8", "replace")
                    out |= {"n": pa.array([len(ids)], pa.int64()), "crc": pa.array([zlib.crc32(np.ascontiguousarray(ids, "<u4"))], pa.int64()), "same": [spelt == own]}
                else:
                    out["ids"] = pa.array([ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    of_chunk = "n long, crc long, same boolean" if digest else "ids array<int>"
    traced = cut.join(paths, ["row", "k"]).mapInArrow(trace, f"doc_id long, row long, k int, {of_chunk}")
    if not digest:
        whole = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("p"))  # of one document
        return few.unionByName(whole.select("doc_id", F.size("p").alias("n_chunks"), F.flatten("p.ids").alias("ids")))
    whole = traced.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.count("*").cast("int").alias("n_chunks"), F.sum("n").alias("n_tokens"), F.min("same").alias("same"), F.sort_array(F.collect_list(F.struct("k", "crc", "n"))).alias("p")
    )  # a few bytes a chunk

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [crc32_joined([(x["crc"], 4 * x["n"]) for x in p]) for p in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(crc, pa.int64()), batch.column(3)], ["doc_id", "n_chunks", "n_tokens", "ids_crc32", "same"])

    return few.unionByName(whole.select("doc_id", "n_chunks", "n_tokens", "same", "p").mapInArrow(sums, kind))


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Null ids are an empty text; bytes that are no character become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for batch in batches:
            texts = [p.decode(np.array(i or [], np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
