"""Runs of words against a search through all starts and periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from mergestone.llm import periodic_runs as P
from mergestone.llm import queries as Q

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    for c in WHITE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def expected(doc_id, text):
    w = words(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute(w)
    drop = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (
        doc_id, len(runs), *(best if best else (None, None, None)), best[1] * 1000 // best[2] if best else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in drop).encode()).hexdigest(),
    )


def odd_texts(rng, k):
    out = []
    for _ in range(k):
        w = []
        for _ in range(rng.randrange(1, 6)):
            base = [rng.choice("abcdé") for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 13, 17, 24, 40]))]
            m = int(len(base) * rng.uniform(0.5, 7))
            w += [base[i % len(base)] for i in range(m)]
            if rng.random() < 0.3 and w:
                w[rng.randrange(len(w))] = "z"
        out.append(w)
    return out


def test_runs_of_many_texts_at_once():
    rng = random.Random(5)
    texts = odd_texts(rng, 600)
    # nested periods: small runs inside the period of a large one
    texts += [(["a"] * k + ["b"] * j) * 5 for k in range(1, 30, 3) for j in range(1, 30, 4)] + [((["a", "b"] * k + ["c"]) * 5 + ["d"]) * 4 for k in range(1, 9)] + [["x"] * 5, ["x"] * 6, [], ["y"], [str(i) for i in range(500)]]
    code = {}
    flat = np.array([code.setdefault(x, len(code)) for w in texts for x in w], np.int64)
    first = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
    got = {}
    for k, s, e, q in P.find(flat, first).tolist():
        got.setdefault(k, []).append((s - first[k], e - s, q))
    for k, w in enumerate(texts):
        assert got.get(k, []) == brute(w), w


def test_synchronising_set_is_sparse_and_repeats_with_the_period():
    rng = np.random.default_rng(3)
    block = rng.integers(0, 50, 100)
    word = np.concatenate([block] * 6)
    at = np.arange(len(word) - 15)
    name = P.repeated(np.array([hash(tuple(word[i : i + 16])) for i in at]))[0]
    inside = P.synchronising(len(word), at, name, np.zeros((0, 4), np.int64), 16)
    assert (inside[:400] == inside[100:500]).all() and 0 < inside.sum() < len(word) / 4
    same = np.zeros(1000, np.int64)  # one word again and again: nothing is chosen once the run is known
    at = np.arange(985)
    assert P.synchronising(1000, at, np.zeros(985, np.int64), np.array([[0, 0, 1000, 1]]), 16).sum() == 0


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(w)) for i, w in enumerate(odd_texts(rng, 250))]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "a " * 50_000), (304, "           "), (305, " ".join(f"w{i % 997}" for i in range(5_000)))]
    rows += [(None, "k " * 9), (None, None), (7, rows[7][1]), (7, "other " * 6), (-4, "m n " * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.withColumns({"runs": docs.doc_id, "n": docs.text, "w": docs.text}).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in Q.op11_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    cheap = {303: [(0, 50_000, 1)]}
    want = [expected(*r) for r in rows if r[0] not in cheap]
    assert sorted((r for r in got if r[0] not in cheap), key=repr) == sorted(want, key=repr)
    assert next(r for r in got if r[0] == 303)[1] == 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert Q.op11_periodic_runs(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("period", [8, 15, 16, 17, 31, 33, 100])
def test_proposals_of_one_period(period):
    rng = np.random.default_rng(period)
    word = np.concatenate([rng.integers(100, 200, 50), np.tile(rng.integers(0, 3, period), 5)[: 4 * period], rng.integers(100, 200, 50)])
    w = word.tolist()
    assert [(s, e - s, q) for _, s, e, q in P.find(word, np.array([0, len(word)])).tolist()] == brute(w)
