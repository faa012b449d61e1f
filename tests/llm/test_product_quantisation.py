import numpy as np

from mergestone.llm import product_quantisation as P


def table():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 32))
    rows = [(i, v) for i, v in enumerate(base)]
    for k in range(120):  # near copies on either side of the bound
        v = base[k % 10] + rng.normal(size=32) * rng.choice([0.05, 0.2, 0.45, 0.6])
        rows.append((1000 + k, v))
    rows += [(2000 + k, base[3]) for k in range(30)] + [(2100, base[3] * 7), (2101, -base[3])]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    odd = [(3000, None), (3001, [0.0] * 32), (3002, [float("nan")] * 32), (3003, [float("inf")] + [1.0] * 31), (3004, [None] + [1.0] * 31), (3005, []), (3006, [1.0, 2.0]), (None, rows[0][1]), (5, rows[5][1])]
    return rows, odd


def brute(rows):
    x = P.units(np.array([v for _, v in rows]))
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    low = P.linked_groups(len(rows), *np.nonzero(near))
    ids = np.array([i for i, _ in rows])
    return near, {g: int(ids[low == g].min()) for g in set(low.tolist())}, low


def test_all_links_are_found(spark):
    rows, odd = table()
    every = rows + odd[-1:]
    near, names, low = brute(every)
    want = sorted((i, int(k.sum()), names[g], i == names[g]) for (i, _), k, g in zip(every, near, low.tolist()))
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, n_links int").repartition(3)
    for s in (P.Settings(), P.Settings(per_list=8, chunk=10, queries=40, probes=12)):
        got = [tuple(r) for r in P.embedding_classes(df, s).collect()]
        assert len(got) == len(rows) + len(odd)
        alone = sorted([g for g in got if g[0] is None or g[0] >= 3000], key=str)
        assert alone == sorted([(i, 0, i, True) for i in range(3000, 3007)] + [(None, 0, None, False)], key=str)
        assert sorted(g for g in got if g[0] is not None and g[0] < 3000) == want


def test_recall_on_vectors_with_many_lists():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    x[3000:] = x[:3000] + rng.normal(size=(3000, 64)) * 0.4
    u = P.units(x).astype(np.float32)
    s = P.Settings()
    index = P.Index(u, len(u), s)
    lists = index.probes(u)
    cos = (u[:3000] * u[3000:]).sum(1)
    pairs = np.flatnonzero(cos >= 0.9)
    seen = [lists[3000 + i, 0] in lists[i] for i in pairs]
    assert len(pairs) > 1000 and np.mean(seen) >= 0.95
    for i in pairs[:200]:  # no vector of a visited list is lost to its code
        codes, error = index.encode(u[3000 + i : 3001 + i], lists[3000 + i, 0])
        assert len(index.candidates(u[i : i + 1], lists[3000 + i, 0], codes, error)[0]) == 1


def test_both_ends_count_a_pair_found_one_way(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(400, 16))
    x = np.concatenate([base, base + rng.normal(size=(400, 16)) * 0.4, base[:20] * 2, base[20:30]])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    s = P.Settings(per_list=8, probes=2, chunk=30, queries=100)
    distinct = sorted({tuple(v): i for i, v in reversed(rows)}.items(), key=lambda r: r[1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r.n_links for r in P.embedding_classes(df, s).collect()}
    # the same index, on nodes in the order of the table
    nodes = spark.createDataFrame([(i, list(v)) for v, i in distinct], "node long, embedding array<double>")
    order = [r.node for r in nodes.orderBy(P.F.xxhash64("node")).collect()]
    of = {i: v for v, i in distinct}
    index = P.Index(P.units(np.array([of[i] for i in order])).astype(np.float32), len(order), s)
    u = P.units(x)
    lists = index.probes(u.astype(np.float32))
    reach = (lists[:, None, :] == lists[None, :, :1]).any(2)
    same = (x[:, None] == x[None]).all(2)
    near = (u @ u.T >= s.cosine) & (reach | reach.T | same)
    np.fill_diagonal(near, False)
    assert (near & ~reach & ~same).any()
    assert [got[i] for i in range(len(x))] == near.sum(1).tolist()


def test_empty_table(spark):
    assert P.embedding_classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_any_length_and_any_finite_norm_links(spark):
    rows = [(1, [1e-160, 2e-160]), (2, [1e-160, 2e-160]), (3, [1e155, 2e155]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0]), (6, [0.0, 0.0]), (7, None), (8, []), (9, [5e-324, 1e-323]), (10, [-1.0, 5.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in P.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 4: (1, 4, True), 5: (1, 4, False), 6: (0, 6, True), 7: (0, 7, True), 8: (0, 8, True), 9: (3, 1, False), 10: (0, 10, True)}
