import math
import zlib
from collections import Counter

import numpy as np
import pytest

from mergestone.llm import log_bilinear as L
from mergestone.llm.simhash import words

SHAPE = L.Shape(head=6, classes=5, table=9, groups=4)


def corpus():
    rng = np.random.default_rng(3)
    one, two = [f"al{i}" for i in range(30)], [f"bo{i}" for i in range(30)]
    rows = []
    for i in range(400):
        words = one if i % 2 else two
        rows.append((i, " ".join(rng.choice(words, 20, p=np.arange(30, 0, -1) / 465)) + (" Once" + str(i) if i % 9 == 0 else "")))
    return [*rows, (1001, None), (1002, ""), (1002, " \n"), (None, "al1 zzz"), (1003, "al1 " * 30000)]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(d, t, 1.0) for d, t in corpus()], "doc_id long, text string, score double").repartition(3)
    return [r.asDict() for r in L.score_documents(df, SHAPE).collect()]


def test_base_is_the_stated_formula(scored):
    count = Counter()
    for d, t in corpus():
        if not held(d):
            count.update([*words(t), L.END])
    n, v = sum(count.values()), len(count)
    want = []
    for d, t in corpus():
        ws = [*words(t), L.END]
        want.append((str(d), held(d), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)))
    assert sorted(want) == sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scored)


def test_the_model_beats_the_base_on_held_out_rows(scored):
    rows = [r for r in scored if r["held_out"] and r["n_tokens"] > 5]
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 0.05 * sum(r["n_tokens"] for r in rows)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    counts = {bytes(r.word): r.c for r in L.count_words(df).collect()}
    lex = L.lexicon(L.count_words(df), SHAPE).prepare()
    model = L.Model(SHAPE, lex.prior)
    model.out[:] = np.random.default_rng(0).normal(0, 1, model.out.shape)
    ctx = np.array([[0, 3, SHAPE.symbols]] * SHAPE.symbols)[:, : SHAPE.order]
    p = np.exp(model.log_probability(ctx, np.arange(SHAPE.symbols)))
    assert abs(p.sum() - 1) < 1e-5
    head = set(lex.words[: SHAPE.head])
    for k in range(SHAPE.classes):
        own = [c for w, c in counts.items() if w not in head and L.class_of(w, SHAPE.classes) == k]
        assert abs(sum(10 ** float(lex.word_log10(np.array(c), np.array(k))) for c in own) + 10 ** float(lex.word_log10(np.array(0), np.array(k))) - 1) < 1e-9


def brute(model, ctx, target):
    """The stated formula, in double precision, one token at a time."""
    out = []
    for c, t in zip(ctx, target):
        q = sum(model.inp[j * (model.shape.symbols + 1) + x].astype(float) for j, x in enumerate(c))
        top = model.top.astype(float) @ q + model.top_bias
        g = model.group[t]
        own = np.array([i for i in range(model.shape.symbols) if model.group[i] == g])
        inner = model.out[model.place[own]].astype(float) @ q + model.bias[model.place[own]]
        log_softmax = lambda x, i: x[i] - x.max() - math.log(np.exp(x - x.max()).sum())
        out.append(log_softmax(top, g) + log_softmax(inner, list(own).index(t)))
    return np.array(out)


@pytest.mark.parametrize("factor", [1, 20, 4000])
def test_log_probability_is_the_stated_formula(factor):
    shape, rng = L.Shape(head=40, classes=13, groups=7), np.random.default_rng(5)
    model = L.Model(shape, rng.random(shape.symbols) ** 4)
    model.out *= factor
    model.top *= factor
    symbol = rng.integers(0, shape.symbols, 400)
    ctx = model.contexts(symbol, np.array([0, 1, 2, 50, 390]))
    assert ctx[50].tolist() == [53, 53, 53] and ctx[52].tolist() == [symbol[51], symbol[50], 53] and ctx[399].tolist() == symbol[[398, 397, 396]].tolist()
    assert np.abs(model.log_probability(ctx, symbol) - brute(model, ctx, symbol)).max() < 1e-3 * factor


def test_training_finds_what_contexts_tell():
    shape, rng = L.Shape(head=30, classes=10, groups=6), np.random.default_rng(6)
    after = rng.permutation(shape.symbols)
    symbol = [0]
    for _ in range(60_000):  # half of the time the next symbol follows from the last
        symbol.append(after[symbol[-1]] if rng.random() < 0.5 else int(rng.integers(0, shape.symbols)))
    symbol = np.array(symbol)
    model = L.Model(shape, np.bincount(symbol, minlength=shape.symbols) / len(symbol))
    ctx = model.contexts(symbol, np.array([0]))
    plain = model.log_probability(np.full_like(ctx, shape.symbols), symbol)[50_000:].mean()
    model.start()
    for lo in range(0, 50_000, 500):
        model.step(ctx[lo : lo + 500], symbol[lo : lo + 500])
    assert model.log_probability(ctx, symbol)[50_000:].mean() > plain + 0.5


def test_the_trained_part_beats_the_same_score_without_contexts(spark):
    df = spark.createDataFrame([(i, ("aa bb cc dd ee ff " * 40 if i % 2 else "ff dd bb ee cc aa " * 40)) for i in range(300)], "doc_id long, text string").repartition(2)
    got = [r for r in L.score_documents(df, L.Shape(head=7, classes=3, groups=3)).collect() if r.held_out]
    assert len(got) > 10 and sum(r.score for r in got) > sum(r.plain_score for r in got) + 0.2 * sum(r.n_tokens for r in got)


def test_nothing_to_learn_from(spark):
    assert L.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    d = next(i for i in range(100) if held(i))
    got = L.score_documents(spark.createDataFrame([(d, "a b")], "doc_id long, text string")).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0) and math.isfinite(got.score) and abs(got.base_score) < 1e-9
