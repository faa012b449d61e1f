import time

import numpy as np
import pytest

from mergestone.llm import decontamination as D


def filler(rng, n):
    return " ".join(f"w{i}" for i in rng.integers(0, 400, n))


def made(rng):
    return [(i, filler(rng, n)) for i, n in enumerate([15, 22, 33, 47, 59, 70, 150, 8, 5, 3, 1, 2])] + [(90, ""), (91, None)]


def brute(index, text):
    h = D.hashes_of(text)
    out = {}
    for k, (i, own) in enumerate(index.items):
        best = max((index.similarity(k, h[a : a + len(own)]) for a in range(max(1, len(h) - len(own) + 1))), default=0)
        if best >= 0.8:
            out[i] = best
    return out


def test_exact_and_edited_passages():
    rng = np.random.default_rng(0)
    index = D.Items(made(rng))
    lost = total = 0
    for _ in range(60):
        i = rng.integers(0, 10)
        words = (made(np.random.default_rng(0))[i][1]).split()
        edited = rng.random() < 0.5 and len(words) > 30
        if edited:
            words[rng.integers(0, len(words))] = "other"
        text = filler(rng, rng.integers(0, 40)) + " " + " ".join(words).upper().replace(" ", ", ") + ". " + filler(rng, rng.integers(0, 40))
        got = {m[0]: m[1] for m in index.matches(text)}
        want = brute(index, text)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got if k in want) and set(got) <= set(want)
        if not edited:
            assert int(i) in got and got[int(i)] == 1
        lost += len(set(want) - set(got))
        total += len(want)
    assert lost <= 0.05 * total


@pytest.mark.parametrize("radius", [7, D.RADIUS])
def test_no_fingerprint_within_the_radius_is_lost(radius):
    rng = np.random.default_rng(3)
    text = filler(rng, 3000)
    index = D.Items([(0, filler(rng, 30)), (1, " ".join(text.split()[700:730])), (2, " ".join([*text.split()[1500:1520], "x", "y", *text.split()[1522:1540]]))])
    h = D.hashes_of(text)
    got = {(k, a, d) for k, a, d in index.candidates(h, radius)}
    want = set()
    for c, (prints, who, _) in index.classes.items():
        f = np.array([index.prints(h[i : i + c], c)[0] for i in range(len(h) - c + 1)], np.uint64)
        for a, b in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ prints[None]) <= radius)):
            want.add((who[b][0], int(a) - who[b][1], int(np.bitwise_count(f[a] ^ prints[b]))))
    assert got == want and {k for k, _, _ in got} >= ({1, 2} if radius == D.RADIUS else {1})


def test_edited_and_truncated_passages_alone():
    rng = np.random.default_rng(8)
    lost = total = 0
    for n, edits, cut in [(26, 1, 0), (48, 1, 0), (50, 1, 0), (88, 2, 0), (95, 2, 0), (160, 3, 0), (14, 0, 2), (19, 0, 3), (26, 0, 3), (35, 0, 5), (48, 0, 8)] * 30:
        words = [f"w{i}" for i in rng.integers(0, 30000, n)]
        index = D.Items([(0, " ".join(words))])
        for k in rng.choice(n, edits, replace=False):
            words[k] = "other"
        words = words[cut:] if rng.random() < 0.5 else words[: n - cut]
        text = " ".join(words if cut else [*filler(rng, 10).split(), *words, *filler(rng, 10).split()])
        want, got = brute(index, text), {m[0]: m[1] for m in index.matches(text)}
        assert set(got) <= set(want)
        lost += len(set(want) - set(got))
        total += len(want)
    assert total > 200 and lost <= 0.005 * total


def test_windows_within_the_own_radius_are_found():
    rng = np.random.default_rng(9)
    text = filler(rng, 2000)
    index = D.Items([(i, filler(rng, int(n))) for i, n in enumerate(rng.integers(1, 60, 300))])
    h = D.hashes_of(text)
    want = set()
    for c, (prints, who, _) in index.classes.items():
        f = index.prints(h, c)
        for a, b in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ prints[None]) <= index.radius)):
            want.add((who[b][0], int(a) - who[b][1], int(np.bitwise_count(f[a] ^ prints[b]))))
    assert set(index.candidates(h, index.radius)) == want and len(want) > 100


def test_similarities_of_all_stretches():
    rng = np.random.default_rng(12)
    for n, most in [(3, 4), (5, 9), (9, 6), (40, 12), (40, 300)]:
        index = D.Items([(0, " ".join(f"w{i}" for i in rng.integers(0, most, n))), (1, " ".join(f"w{i}" for i in rng.integers(0, most, 30)))])
        h = D.hashes_of(" ".join(f"w{i}" for i in rng.integers(0, most, 90)))
        got = index.similarities(0, h, -n, 90)
        assert all(abs(got[a + n] - index.similarity(0, h[max(0, a) : max(0, a + n)])) < 1e-9 for a in range(-n, 91))


def test_long_items_take_time_in_proportion():
    rng = np.random.default_rng(13)
    item = filler(rng, 40_000)
    index = D.Items([(0, item), (1, filler(rng, 12))])
    began = time.thread_time()
    assert index.matches(filler(rng, 3000) + " " + item + " " + filler(rng, 10)) == [(0, 1.0, 3000, 1)]
    assert time.thread_time() - began < 30


def test_sums_do_not_wrap():
    assert D.running(np.ones((70_000, 64), np.uint8))[-1, 0] == 70_000


def test_contaminated(spark):
    rng = np.random.default_rng(0)
    items = made(rng)
    rows = [(1, filler(rng, 50) + " " + items[3][1] + " " + items[0][1], "s"), (2, filler(rng, 900), "s"), (2, filler(rng, 90) + " " + items[4][1], "s"), (3, None, "s"), (4, "", "s"), (None, items[6][1], None), (5, (filler(rng, 9000) + " " + items[2][1] + " ") * 2 + filler(rng, 20000), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([i for i in items if i[0] < 9 or i[0] >= 90] + [(3, items[3][1])], "item_id long, text string")
    for bound in (16_000_000, 200):
        got = sorted([(r.doc_id, r.item_id, r.n_windows) for r in D.contaminated(df, bench, bound=bound).filter("item_id < 8").collect()], key=str)
        assert got == sorted([(1, 3, 1), (1, 0, 1), (2, 4, 1), (None, 6, 1), (5, 2, 2)], key=str)
    assert D.contaminated(df.limit(0), bench).count() == 0 and D.contaminated(df, bench.limit(0)).count() == 0
