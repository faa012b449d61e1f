import numpy as np
import pytest

from mergestone.llm import simhash as S


def brute(f, radius):
    d = np.bitwise_count(f[:, None, :] ^ f[None, :, :]).sum(-1)
    group = np.arange(len(f))
    for i, j in zip(*np.nonzero(d <= radius)):
        if group[i] != group[j]:
            group[group == max(group[i], group[j])] = min(group[i], group[j])
    return group


def joined(n, pairs):
    group = np.arange(n)
    for i, j in pairs:
        if group[i] != group[j]:
            group[group == max(group[i], group[j])] = min(group[i], group[j])
    return group


def noisy(rng, n, bits, flips):
    base = rng.integers(0, 2**64, (max(1, n // 8), bits // 64), dtype=np.uint64)
    f = base[rng.integers(0, len(base), n)].copy()
    for row in f:
        for b in rng.integers(0, bits, rng.integers(0, flips + 1)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return f


@pytest.mark.parametrize("bits,radius,n", [(64, 4, 300), (128, 30, 200), (64, 0, 70), (64, 4, 1)])
def test_bit_sliced_equals_brute_force(bits, radius, n):
    rng = np.random.default_rng(n)
    f = noisy(rng, n, bits, max(1, radius // 2))
    assert (joined(n, S.spanning(f, bits, radius)) == brute(f, radius)).all()
    a, b = S.small_links(f, np.zeros(n, int), bits, radius)
    d = np.bitwise_count(f[:, None, :] ^ f[None, :, :]).sum(-1)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in zip(*np.nonzero(d <= radius)) if i < j}


def test_two_sides():
    rng = np.random.default_rng(5)
    f = noisy(rng, 900, 64, 3)
    side = rng.integers(0, 2, 900)
    d = (np.bitwise_count(f[:, None, :] ^ f[None, :, :]).sum(-1) <= 4) & (side[:, None] != side[None, :])
    assert (joined(900, S.spanning(f, 64, 4, side)) == joined(900, zip(*np.nonzero(d)))).all()


def test_fingerprint_is_the_stated_majority():
    import xxhash

    text = "One two THREE four\tfive\nsix Ünder score one two three four"
    h = [xxhash.xxh64_intdigest(s, 42) for s in S.shingles(S.words(text), 4)]
    want = sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))
    assert int(S.text_fingerprint(text)[0]) == want
    assert S.shingles(S.words("a b"), 4) == [b"a b"] and S.text_fingerprint(" \n")[0] == 0 == S.text_fingerprint(None)[0]


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(1)
    keys = S.block_keys(64, 4, 6)
    for _ in range(200):
        flips = set(rng.choice(64, 4, replace=False).tolist())
        assert any(not flips & set(k) for k in keys)


def test_classes(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(60):
        w = rng.choice(vocabulary, 300).tolist()
        rows += [(i * 10, " ".join(w)), (i * 10 + 1, " ".join(w).upper()), (i * 10 + 2, " ".join([*w[:150], "changed", *w[151:]]))]
    rows += [(5001, ""), (5002, None), (5003, " \n "), (5004, "short text"), (5004, "short text"), (None, "short text"), (5005, "x " * 50000)]
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, fingerprint string, component_id int").repartition(5)
    for chunk in (8192, 4):
        got = S.simhash_classes(df, chunk=chunk).collect()
        assert len(got) == len(rows)
        f = np.array([S.text_fingerprint(t) for _, t in rows])
        group = brute(f, 4)
        low = {}
        for (d, _), g in zip(rows, group):
            low[g] = min([x for x in (low.get(g), d) if x is not None], default=None)
        want = sorted((str(d), f"{int(p[0]):016x}", low[g]) for (d, _), p, g in zip(rows, f, group))
        assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_empty_table(spark):
    assert S.simhash_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [40, 400])
def test_known_groups_are_kept_and_not_linked_again(n):
    rng = np.random.default_rng(n)
    f = noisy(rng, n, 128, 20)
    known = rng.integers(0, n // 4, n)
    d = np.bitwise_count(f[:, None, :] ^ f[None, :, :]).sum(-1) <= 30
    want = joined(n, [*zip(*np.nonzero(d)), *((i, j) for i in range(n) for j in range(i) if known[i] == known[j])])
    for pairs in (S.spanning(f, 128, 30, None, known), list(zip(*S.small_links(f, np.zeros(n, int), 128, 30, known)))):
        assert all(known[i] != known[j] for i, j in pairs)
        assert (joined(n, [*pairs, *((i, j) for i in range(n) for j in range(i) if known[i] == known[j])]) == want).all()
