"""Similarity joins and clusters against plain loops over all pairs."""

import random

import pytest

from mergestone.functions.text import _common
from mergestone.operators import resolution as R
from mergestone.operators import similarity_join as S


def score(a, b):
    x, y = " ".join(sorted(a.split(" "))), " ".join(sorted(b.split(" ")))
    return 100.0 if not x + y else round(200.0 * _common(x, y) / (len(x) + len(y)), 6)


def names(rng, n):
    words = ["fry", "basket", "noodle", "café", "de", "la", "grill", "kitchen", "aaaa", "aaaaaaa", "zz", "日本", "ale", "alps", "b"]
    out = [" ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(n)]
    for i in range(n // 2):  # near copies
        w = list(rng.choice(out))
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "x", "e"])
        out.append("".join(w).strip())
    return out + ["", "a", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefg", "b", "ba"]


@pytest.mark.parametrize("least", [70.0, 85.0, 90.0, 97.0])
def test_all_pairs_are_found(spark, least, monkeypatch):
    monkeypatch.setattr(S, "PART", 7)  # lists and blocks are split
    rng = random.Random(int(least))
    keys = sorted({" ".join(sorted(k.split(" "))) for k in names(rng, 130)})
    rows = [(b, k) for b in ("x", "y") for k in keys if rng.random() < 0.8] + [(None, "abc"), ("x", None)]
    a = spark.createDataFrame(rows, "block string, a string")
    b = spark.createDataFrame(rows, "block string, b string")
    want = sorted((p, x, y, s) for p, x in rows for q, y in rows if p and p == q and x is not None and y is not None and x <= y and (s := score(x, y)) >= least)
    assert sorted(tuple(r) for r in S.similar(a, b, least, once=True).collect()) == want
    assert S.similar(a, b, least).count() == 2 * len(want) - sum(x == y for _, x, y, _ in want)


def test_best_match_of_each_record(spark):
    rng = random.Random(4)
    keys = names(rng, 60)
    records = [(i, rng.choice("xy"), k) for i, k in enumerate(keys)] + [(900, "none", "abc"), (901, None, "abc"), (902, "x", None)]
    entities = [(1000 + i, rng.choice("xy"), k, rng.random() < 0.5) for i, k in enumerate(rng.sample(keys, 40) + keys[:5])]
    got = {r["record"]: (r["entity"], r["score"], r["outcome"]) for r in R.matched(spark.createDataFrame(records, "record long, block string, key string"), spark.createDataFrame(entities, "entity long, block string, ekey string, is_active boolean")).collect()}
    for i, block, key in records:
        near = [(score(key, k), live, -e) for e, b, k, live in entities if key is not None and b == block]
        best = max(near, default=None)
        want = (None, None, "new_entity") if best is None else (-best[2] if best[0] >= 70 else None, best[0], "auto_merge" if best[0] >= 90 else "review" if best[0] >= 70 else "new_entity")
        assert got[i] == want, (key, got[i], want)


def sequential(records):
    leaders, led = {}, {}
    for record, block, key in sorted(records):
        if (block, key) not in led:
            near = [(s, -r) for r, k in leaders.get(block, []) if (s := score(k, key)) >= 90]
            if near:
                led[block, key] = -max(near)[1]
            else:
                leaders.setdefault(block, []).append((record, key))
                led[block, key] = record
    return sorted((record, led[block, key]) for record, block, key in records)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    keys = names(rng, 150) + ["grill la de", "de la grill", "la grill de"]
    # a long chain: each key is near the one before and the one after
    keys += ["abcdefghijklmnopqrst"[i:] + "uvwxyzabcdefghijklmn"[:i] for i in range(20)]
    rng.shuffle(keys)
    records = [(i, "one", k) for i, k in enumerate(keys + keys[:20])] + [(500 + i, "two", k) for i, k in enumerate(keys[:50])]
    got = R.leader_clusters(spark.createDataFrame(records, "record long, block string, key string")).collect()
    assert sorted((r["record"], r["leader"]) for r in got) == sequential(records)


def test_clusters_of_nothing_and_nulls(spark):
    none = spark.createDataFrame([], "record long, block string, key string")
    assert R.leader_clusters(none).count() == 0
    odd = spark.createDataFrame([(1, None, "a"), (2, "x", None), (3, "x", "a"), (4, "x", "a")], "record long, block string, key string")
    assert sorted((r["record"], r["leader"]) for r in R.leader_clusters(odd).collect()) == [(1, 1), (2, 2), (3, 3), (4, 3)]
