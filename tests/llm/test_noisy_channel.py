import itertools
import zlib

import numpy as np
import pytest

from mergestone.llm import noisy_channel as N

CLEAN = ["the harbour office wrote letters", "stone bridges carry people over rivers", "every morning boats leave early", "they sell bread and honey there"]
BAD = ["idiot", "stupid", "worthless"]


def trained():
    count = {}
    for w in " ".join(CLEAN * 5 + BAD * 8).split():
        for i in range(len(w) + 1):
            t = f"  {w} "[i : i + 3]
            count[t] = count.get(t, 0) + 1
    return N.Counts.of(count)


@pytest.mark.parametrize(
    "text,word",
    [("an 1d10t here", "idiot"), ("you 1diot!", "idiot"), ("so i d i o t they", "idiot"), ("a s.t.u.p.i.d. one", "stupid"), ("stuuuuupid", "stupid"), ("$tup1d boats", "stupid"), ("w0rthle$s", "worthless"), ("w-o-r-t-h-l-e-s-s", "worthless"), ("id!ot", "idiot"), ("STUPID,", "stupid")],
)
def test_restores(text, word):
    assert word in N.Restorer(trained()).words(text)


def test_leaves_clean_words_alone():
    r = N.Restorer(trained())
    for t in CLEAN:
        assert r.words(t + " *** !! 12 a$$$") >= set(t.split())
        assert not r.words(t) & set(BAD)


def test_viterbi_finds_the_best_path():
    model = N.Characters(trained())
    for stretch in ["1d10t", "b0at$", "s t", "aaa", "3v3ry"]:
        options, before = [], ""
        for ch in stretch:
            options.append(N.arcs(ch, before))
            before = ch

        def cost(path):
            h, total, out = "  ", 0.0, []
            for c, extra in path:
                if c == " " and h[1] == " ":
                    continue
                total += extra
                if c:
                    total += model.cost(h + c)
                    h = h[1] + c
                    out.append(c)
            return total + (0 if h[1] == " " else model.cost(h + " ")), "".join(out)

        best = min((cost(p) for p in itertools.product(*options)), key=lambda x: x[0])
        got = N.restored(stretch, model)
        assert abs(min(c for c, t in (cost(p) for p in itertools.product(*options)) if t == got) - best[0]) < 1e-9


def rows():
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(1500):
        words = rng.choice(" ".join(CLEAN).split(), 30).tolist()
        bad = i % 6 == 0
        if bad:
            w = BAD[i // 6 % 3]
            words[5] = w
            words[9] = w.replace("i", "1").replace("o", "0").replace("s", "$") if i % 12 == 0 else w
        docs.append((i, " ".join(words)))
        if i % 5 != 4:
            labels.append((i, int(bad)))
    docs += [(5000, None), (5001, ""), (5002, "1d10t i d i o t"), (None, "stupid idiot"), (5003, "the boats " * 40000), (5002, "1d10t i d i o t")]
    return docs, labels + [(0, None), (None, 1), (3, 7)]


def test_held_out_rows(spark):
    docs, labels = rows()
    d = spark.createDataFrame([(i, t, "src") for i, t in docs], "doc_id long, text string, toxic string").repartition(3)
    got = N.score_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    said = {r.doc_id: r.predicted for r in got}
    truth = {i: int(i % 6 == 0) for i in range(1500)}
    wrong = [i for i, y in truth.items() if zlib.crc32(str(i).encode()) % 3 == 1 and said[i] != y]
    assert len(wrong) <= 3, wrong
    assert said[5002] == 1 and said[None] == 1 and said[5000] == said[5001] == said[5003] == 0


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    d = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    assert {r.predicted for r in N.score_toxicity(d, none).collect()} == {0}
    assert N.score_toxicity(d.limit(0), none).count() == 0


def test_counts_of_rare_trigrams_stay_in_the_sums(spark, monkeypatch):
    df = spark.createDataFrame([("the then them " * 50 + "xyz xyq",), (None,), ("",)], "text string")
    every = N.character_counts(df)
    assert every == N.Counts.of(every.three)
    monkeypatch.setattr(N, "SHARE", 0.01)
    few = N.character_counts(df)
    assert "xyz" in every.three and "xyz" not in few.three and len(few.three) <= 100 and set(few.three) < set(every.three)
    assert few.one == every.one and few.after_one == every.after_one and all(every.two[k] == v for k, v in few.two.items())
    least = 0.01 * sum(every.three.values())
    assert few.two == {k: v for k, v in every.two.items() if v >= least} and few.after_two == {k: v for k, v in every.after_two.items() if v >= least}


def test_character_counts_in_one_pass():
    from collections import Counter

    text = "the  Boats, é. x-ray 12ab"
    want = Counter()
    for w in ["the", "boats", "é", "x", "ray", "ab"]:
        want.update(f"  {w} "[i : i + 3] for i in range(len(w) + 1))
    keys, counts = N.trigram_counts(text.lower())
    got = {"".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0)): c for k, c in zip(keys.tolist(), counts.tolist())}
    assert got == dict(want)


def test_evidence_by_token_is_that_of_the_words():
    r = N.Restorer(trained())
    s = N.Scorer({"idiot": 3.0, "stup~": 2.0, "worthless": 1.0, "a": 0.5}, np.zeros(4))
    for t in ["", None, "you 1d10t and i d i o t", "a b c", "Stupid stuuupid worthless idiot", "x"]:
        assert N.Telling(N.Restorer(trained()), s).evidence(t) == s.evidence(r.words(t))
