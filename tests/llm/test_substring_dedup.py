"""Passages against all windows of all documents, in plain Python and in SQL; the index against plain search."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from mergestone.llm import fm_index as M
from mergestone.llm import queries as Q
from mergestone.llm import substring_dedup as S


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(docs, length=13):
    first = {}
    split = [(i, words(t or "")) for i, t in docs]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - length + 1):
                t = tuple(w[k : k + length])
                first[t] = min(i, first.get(t, i))
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - length + 1) if i is not None and first[tuple(w[k : k + length])] < i for j in range(length)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(rng, n):
    fresh = lambda k: [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(k)]
    passages = [fresh(rng.choice([12, 13, 14, 20, 60])) for _ in range(12)] + [["ab", "cd"] * 20, ["x"] * 30]
    docs = []
    for i in range(n):
        w = fresh(rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 4)):
            w += rng.choice(passages) + fresh(rng.choice([0, 1, 7, 20]))
        if docs and rng.random() < 0.3:  # a copy with few changes
            w = words(rng.choice(docs)[1])
            for _ in range(rng.randrange(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = "changed"
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return docs


@pytest.mark.parametrize("alphabet, depth", [(2, 5), (3, 13), (20, 4), (300, 16)])
def test_matching_statistics(alphabet, depth):
    rng = np.random.default_rng(alphabet)
    text = np.append(rng.integers(0, alphabet, 3000), 0)
    stream = rng.integers(-1, alphabet + 3, 400)
    stream[50:80] = text[100:130]
    index = M.FMIndex(text, alphabet + 1, depth)
    n, lo, hi = index.matching_statistics(stream, np.arange(400), depth)
    plain = text.tolist()
    for e in range(400):
        k = 0
        while k < depth and e - k >= 0 and (at := [i for i in range(len(plain) - k) if plain[i : i + k + 1] == stream[e - k : e + 1].tolist()]) and 0 not in stream[e - k : e + 1]:
            k, held = k + 1, at
        assert n[e] == k
        if k:
            assert sorted(index.place[lo[e] : hi[e]].tolist()) == held


def test_pieces_cover_all_windows_once():
    import pyarrow as pa

    docs = corpus(random.Random(2), 60)
    p = S.Pieces(pa.array([t for _, t in docs] + [None, ""]), 13, 5)
    for k, (_, t) in enumerate(docs):
        mine = p.text == k
        got = sorted(i for a, n in zip(p.at[mine] - p.first[k], p.windows[mine]) for i in range(a, a + n))
        assert got == list(range(max(0, len(words(t)) - 12)))
    assert p.windows.max() <= 9


@pytest.mark.parametrize("hot", [False, True])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, hot):
    if hot:  # every anchor is hot, and shards are small
        monkeypatch.setattr(S, "HOT", 10**9)
        monkeypatch.setattr(S, "LEAST_HOT", 0)
        monkeypatch.setattr(S, "SHARD", 500)
    docs = corpus(random.Random(3 + hot), 300)
    docs += [(400, None), (401, ""), (402, "  \n"), (None, docs[0][1]), (None, "a " * 20), (None, None), (5, docs[9][1]), (5, docs[9][1]), (-3, docs[250][1]), (403, " ".join(f"w{i % 5000}" for i in range(30_000))), (404, " ".join(f"w{i}" for i in range(5000)))]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    a.withColumns({"r": a.text, "spans": a.text, "kept": a.text, "h": a.text}).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in Q.op13_substring_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(docs)


def test_other_lengths(spark):
    docs = corpus(random.Random(8), 120)
    a = spark.createDataFrame(docs, "doc_id long, text string")
    got = S.without_repeated_passages(a, length=6, anchor=2).collect()
    assert sorted(((r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in got), key=repr) == brute(docs, 6)


def test_empty_table(spark):
    assert S.without_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df = Q.op13_substring_dedup(spark, sf)
    cur = duck.execute(Q.ORACLE["op13_substring_dedup"])
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(tuple(r) for r in df.collect()) == sorted(cur.fetchall())
