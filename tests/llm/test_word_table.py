import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mergestone.llm import word_table as W


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("aB é\n\x0b\x1c你z"), max_size=40), max_size=8), st.sampled_from([3, 50, 10_000]))
def test_spans_are_the_words(texts, size):
    column, got = pa.array(texts, pa.string()), []
    for a, b in W.pieces_of(column, size):
        raw, start = W.bytes_of(column.slice(a, b - a))
        begin, end, first = W.spans(raw, start)
        got += [[raw[x:y].tobytes() for x, y in zip(begin[i:j], end[i:j])] for i, j in zip(first, first[1:])]
    assert got == [(t or "").encode().split() for t in texts]


def test_keys_and_numbers():
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(97, 100, rng.integers(1, 14)).astype(np.uint8)) for _ in range(30_000)] + [b"a" * k for k in range(1, 300)] + [b"a" * 299 + b"b"]
    raw = np.frombuffer(b" ".join(words) + bytes(8), np.uint8)
    begin, end, _ = W.spans(raw, np.array([0, len(raw) - 8]))
    table, known = W.Numbers(), {}
    for lo in range(0, len(words), 777):
        part = slice(lo, lo + 777)
        number, new = table.found(W.keys(raw, begin[part], end[part]))
        fresh = [i for i, w in enumerate(words[part]) if w not in words[part][:i] and w not in known]
        assert new.tolist() == fresh
        for i in fresh:
            known[words[lo + i]] = len(known)
        assert number.tolist() == [known[w] for w in words[part]]
    assert len(table) == len(known) and (table.find(np.array([5, 6], np.uint64)) == -1).all()


@pytest.mark.parametrize("kind", [np.uint32, np.uint8])
def test_runs(kind):
    rng, runs, want = np.random.default_rng(1), W.Runs(kind), []
    for _ in range(40):
        own = [rng.integers(0, 200, rng.integers(0, 400)).astype(kind) for _ in range(rng.integers(0, 60))]
        runs.add(np.concatenate([np.zeros(0, kind), *own]), np.array([len(x) for x in own], np.int64))
        want += own
    pick = rng.integers(0, len(want), 500)
    values, end = runs.take(pick)
    assert all((a == want[k]).all() for a, k in zip(np.split(values, end[:-1]), pick))
