"""Cells of the similarity join: scores against a plain loop, and how few pairs are scored at all."""

import random

import pytest
from pyspark.sql import functions as F

from mergestone.functions.text import _common
from mergestone.operators import resolution as R
from mergestone.operators import similarity_join as S


def score(a, b):
    return 100.0 if not a + b else round(200.0 * _common(a, b) / (len(a) + len(b)), 6)


def keys(rng, n):
    """Keys of up to 400 letters, with near copies whose edits fall anywhere, so that places carry from word to word."""
    words = ["fry", "de", "aaaaaaaaaa", "日本", "kitchen", "ab" * 35, "noodle" * 20, "x"]
    out = [" ".join(sorted(rng.choices(words, k=rng.randrange(1, 6)))) for _ in range(n)]
    for _ in range(n):
        w = list(rng.choice(out))
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "q", "a", "本"])
        out.append("".join(w))
    return sorted({*out, "", "a" * 63, "a" * 64, "a" * 65, "\0", "a\0"})


@pytest.mark.parametrize("least", [0.0, 70.0, 90.0, 100.0])
@pytest.mark.parametrize("pairs", [7, S.PAIRS])
def test_cells_equal_a_plain_loop(least, pairs, monkeypatch):
    monkeypatch.setattr(S, "PAIRS", pairs)
    rng = random.Random(int(least) + pairs)
    a, b = keys(rng, 50), keys(rng, 40)
    got = sorted((p, q, int(c)) for x, y, n in S.meeting(a, b, least) for p, q, c in zip(x, y, n) if score(p, q) >= least)
    assert got == sorted((p, q, _common(p, q)) for p in a for q in b if score(p, q) >= least)
    got = sorted((*sorted((p, q)), int(c)) for x, y, n in S.meeting(a, None, least) for p, q, c in zip(x, y, n) if score(p, q) >= least)
    assert got == sorted((p, q, _common(p, q)) for p in a for q in a if p <= q and score(p, q) >= least)


@pytest.mark.parametrize("some", [[""], ["", "a"], ["a"] * 1 + ["b" * 300], [""] * 1 + [str(k) for k in range(60)]])
def test_small_cells(some):
    got = sorted((*sorted((p, q)), int(c)) for x, y, n in S.meeting(some, None, 90.0) for p, q, c in zip(x, y, n))
    assert got == sorted((p, q, _common(p, q)) for p in some for q in some if p <= q and score(p, q) >= 90)


def test_few_pairs_are_scored(monkeypatch):
    """Headlines of one language hold mostly the same letters, and the same short runs of them."""
    rng = random.Random(3)
    parts = ["th", "the", "tion", "er", "an", "he", "ou", "re", "in", "ed", "ing", "nd", "of", "was", "est"]
    words = ["".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(400)]
    heads = sorted({" ".join(sorted(rng.choices(words, k=10)))[:60] for _ in range(2000)})
    heads += [h[:20] + "zz" + h[21:] for h in heads[:20]]
    tried = []
    scored = S.scored
    monkeypatch.setattr(S, "scored", lambda x, y, i, *rest: (tried.append(len(i)), scored(x, y, i, *rest))[1])
    found = sum(len(x) for x, _, _ in S.meeting(heads, None, 90.0))
    assert found >= len(heads) + 20
    assert sum(tried) < len(heads) ** 2 / 2 / 50


def test_pairs_are_no_rows_before_they_are_scored(spark):
    rows = spark.createDataFrame([("x", "abc"), ("x", "abd")], "block string, a string")
    plan = S.similar(rows, rows.withColumnRenamed("a", "b"), 90.0, once=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # of keys with the number of parts of their block
    assert "FlatMapGroupsInArrow" in plan


def test_clusters_of_one_large_block(spark, monkeypatch):
    """Headlines of one block in several cells: no table of candidates is made, and leaders equal the sequential rule."""
    monkeypatch.setattr(S, "PART", 60)
    plans = {}
    kept = R.kept
    monkeypatch.setattr(R, "kept", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), kept(df, name))[1])
    rng = random.Random(5)
    heads = [" ".join(rng.choices(["thered", "ofing", "the", "anre", "tion", "wh", "ner", "ou"], k=9)) for _ in range(150)]
    heads += [h[:9] + rng.choice("xyz") + h[9:] for h in heads[:60]]
    rng.shuffle(heads)
    got = R.leader_clusters(spark.createDataFrame([(k, "", h) for k, h in enumerate(heads)], "record long, block string, key string")).collect()
    order = lambda h: " ".join(sorted(h.split(" ")))
    leaders, want, led = [], [], {}
    for k, h in enumerate(heads):
        if h not in led:
            near = max(((s, -at) for at, x in leaders if (s := score(order(x), order(h))) >= 90), default=None)
            led[h] = k if near is None else -near[1]
            if near is None:
                leaders.append((k, h))
        want.append((k, led[h]))
    assert sorted((r["record"], r["leader"]) for r in got) == want
    assert len(leaders) < len(set(heads))
    assert plans["near"].count("Join ") == 1 and "FlatMapGroupsInArrow" in plans["near"]


@pytest.mark.parametrize("lot, pairs, words", [(5, 3, 200), (1, 1, 1), (64, 1000, 5000)])
def test_lots_of_pairs_lose_none(lot, pairs, words, monkeypatch):
    """Pairs that the first word of bits lets pass come to the second one, and to their scores, in lots of bounded size."""
    monkeypatch.setattr(S, "LOT", lot)
    monkeypatch.setattr(S, "PAIRS", pairs)
    monkeypatch.setattr(S, "WORDS", words)
    sizes = []
    scored = S.scored
    monkeypatch.setattr(S, "scored", lambda x, y, i, *rest: (sizes.append(len(i)), scored(x, y, i, *rest))[1])
    rng = random.Random(lot)
    for a in (keys(rng, 60), ["".join(rng.choices("abcd", k=300)) for _ in range(20)] + ["abcd" * 75, "abcd" * 74 + "abxcd"], [chr(k) + chr(k + 1) * 9 for k in range(0x20000, 0x20020)]):
        got = sorted((*sorted((p, q)), int(c)) for x, y, n in S.meeting(a, None, 90.0) for p, q, c in zip(x, y, n) if score(p, q) >= 90)
        assert got == sorted((*sorted((p, q)), _common(p, q)) for k, p in enumerate(a) for q in a[k:] if score(p, q) >= 90)
    assert max(sizes) <= pairs


def test_records_of_clusters_are_made_once(spark):
    """Records may come from rows that are much longer, as headlines from pages, so they are not made again for each step."""
    made = spark.sparkContext.accumulator(0)

    def name(k):
        made.add(1)
        return ["fried rice", "fried ricf", "noodles", None][k % 4]

    records = spark.range(40).select(F.col("id").alias("record"), F.lit("").alias("block"), F.udf(name, "string")("id").alias("key"))
    got = dict(R.leader_clusters(records).select("record", "leader").collect())
    assert got == {k: [0, 0, 2, k][k % 4] for k in range(40)}
    assert made.value == 40
