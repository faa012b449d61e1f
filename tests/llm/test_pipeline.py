import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from mergestone.llm import decontamination as D
from mergestone.llm import simhash as S


def jaccard_classes(rows):
    sets = [frozenset(S.shingles(S.words(t), 5)) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = max(group[i], group[j]), min(group[i], group[j])
                group = [b if g == a else g for g in group]
    low = {}
    for (d, _), g in zip(rows, group):
        low[g] = min(d, low.get(g, d))
    return {d: low[g] for (d, _), g in zip(rows, group)}


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(800)]
    rows = []
    for i in range(40):
        w = rng.choice(vocabulary, int(rng.integers(60, 300))).tolist()
        rows.append((i * 100, " ".join(w)))
        for k in range(int(rng.integers(0, 5))):
            v = list(w)
            for _ in range(int(rng.integers(0, max(1, len(w) // 80)))):
                v[int(rng.integers(0, len(v)))] = "edited"
            rows.append((i * 100 + k + 1, " ".join(v)))
    return [*rows, (9001, ""), (9002, None), (9003, "two words"), (9004, "two words"), (9005, "x " * 30000)]


@pytest.mark.parametrize("weight", [1_000_000, 300])
def test_near_duplicates_equal_brute_force(spark, weight):
    rows = corpus(np.random.default_rng(7))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, content string").repartition(4)
    got = {r.doc_id: r.component_id for r in S.near_duplicate_classes(df, weight=weight).collect()}
    assert got == jaccard_classes(rows)


def test_pairs_near_the_bound_equal_brute_force(spark):
    rng = np.random.default_rng(21)
    rows, near = [], 0
    for i in range(900):
        n = int(rng.choice([8, 9, 12, 24, 49, 104, 184, 404]))
        w = [f"v{x}" for x in rng.integers(0, 10**6, n)]
        size = n - 4
        cut = next(c for c in range(n, -1, -1) if 0.8 <= (size - c) / (size + c) or c == 0)
        other = [*w[cut:], *(f"v{x}" for x in rng.integers(0, 10**6, cut))] if cut else [*w, "more"]
        a, b = (set(S.shingles(S.words(" ".join(x)), 5)) for x in (w, other))
        near += 0.8 <= len(a & b) / len(a | b) <= 0.83
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in S.near_duplicate_classes(df).collect()}
    assert near > 500 and all(got[2 * i] == 2 * i for i in range(900))
    short = [i for i in range(900) if len(rows[2 * i][1].split()) <= 24]
    assert all(got[2 * i + 1] == 2 * i for i in short)
    assert np.mean([got[2 * i + 1] == 2 * i for i in range(900) if i not in set(short)]) >= 0.99


def test_set_links_with_sides():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 5000, 60)) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[k // 3 :], rng.integers(9000, 9999, k // 4)])) for b in base for k in range(12)]
    side = rng.integers(0, 2, len(sets))
    like = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    for s in (None, side):
        group = np.arange(len(sets))
        other = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if like(sets[i], sets[j]) and (s is None or s[i] != s[j]):
                    group[group == group[i]] = group[j]
        for i, j in S.set_links(sets, 0.8, s):
            other[other == other[i]] = other[j]
        assert {frozenset(np.flatnonzero(group == g)) for g in group} == {frozenset(np.flatnonzero(other == g)) for g in other}


def test_stages_and_run(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = corpus(rng)
    items = [(i, " ".join(f"q{x}" for x in rng.integers(0, 300, 25))) for i in range(5)]
    bad = [(20000 + i, " ".join([*rng.choice([f"w{k}" for k in range(800)], 40), "vileword", *rng.choice([f"w{k}" for k in range(800)], 40)])) for i in range(60)]
    leaked = [(30000 + i, f"w{i} before {t} after w{i + 7}") for i, t in items]
    every = rows + bad + leaked
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in every], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, 1, int(d in dict(bad))) for d, _ in every]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    clean = [(d, t) for d, t in every if d not in dict(bad)]
    low = jaccard_classes(clean)
    index = D.Items(items)
    want = {d: t for d, t in clean if low[d] == d and not index.matches(t)}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(got) == set(want) and not set(got) & {d for d, _ in leaked}
    assert all(got[d] == lib.encode(t or "") for d, t in want.items())
