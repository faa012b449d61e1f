"""Resampling against plain Python, and against SQL on the given tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from mergestone.llm import importance_resampling as R
from mergestone.llm import queries as Q

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, buckets=10_000, longest=1, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    a, b = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (a + buckets) / ((s[k] + 1) * (b + buckets)))) for k in range(buckets)]
    out = []
    for i, text in docs:
        w, f = features(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((k for k in range(len(out)) if out[k][1] >= least), key=lambda k: (-out[k][4], out[k][0] is None, out[k][0] or 0))
    rank = {k: j + 1 for j, k in enumerate(able[: percent * len(able) // 100])}
    return [(*r, rank.get(k)) for k, r in enumerate(out)]


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(30)] + ["über", "Ärger", "MiXed", "日本", "x" * 16, "y" * 17, "z" * 70, "don't", "a_b"]
    return [(i, rng.choice([" ", "\n", ", "]).join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(n)]


def test_crc_states():
    words = [b"", b"a", b"abc", "é日本".encode(), b"q" * 300]
    end = np.cumsum([len(w) for w in words])
    raw = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    got = R.states(raw, end - [len(w) for w in words], end) ^ R.ALL
    assert got.tolist() == [zlib.crc32(w) for w in words]


def test_head_knows_words_by_all_bytes():
    head = R.Head([b"abc", b"abcdefghij", b"abcdefghijklmnop"], 1000)
    raw, begin, end, _ = R.words_of(pa.array(["abc abcdefghij abcdefghik abcdefghijklmnop abcdefghijklmnoq ab ABC"]))
    assert head.find(raw, begin, end).tolist() == [0, 1, -1, 2, -1, -1, 0]
    assert (head.word_states(raw, begin, end)[1] ^ R.ALL).tolist() == [zlib.crc32(w) for w in b"abc abcdefghij abcdefghik abcdefghijklmnop abcdefghijklmnoq ab abc".split()]


@pytest.mark.parametrize("longest", [1, 2])
def test_against_plain_python(spark, longest, monkeypatch):
    rng = random.Random(longest)
    docs = corpus(rng, 150) + [(500, None), (501, ""), (502, " .,; "), (None, "w1 " * 25), (None, None), (7, "w2 w3 " * 20), (7, "w2 w3 " * 20), (503, "long " * 40_000)]
    target = [t for _, t in corpus(random.Random(9), 20)] + [None, ""]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(t,) for t in target], "text string")
    clash = a.withColumns({"n_words": a.text, "score": a.text, "place": a.text, "able": a.text})
    want = sorted(brute(docs, target, longest=longest), key=repr)
    assert sorted((tuple(r) for r in R.resampled(clash, b, longest=longest).collect()), key=repr) == want
    monkeypatch.setattr(R, "HEAD", 8)  # nearly all features are of the tail
    monkeypatch.setattr(R, "PAIRS", 4)
    assert sorted((tuple(r) for r in R.resampled(a, b, longest=longest).collect()), key=repr) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert R.resampled(none, some).count() == 0
    assert [r["rank"] for r in R.resampled(some, none, percent=100).collect()] == [1]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = Q.op12_importance_resampling(spark, sf)
    cur = duck.execute(Q.ORACLE["op12_importance_resampling"])
    assert [d[0] for d in cur.description] == df.columns
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(cur.fetchall(), key=repr)
