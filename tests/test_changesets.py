"""Changesets in order against a loop over their entries."""

import random

import pytest

from mergestone.operators.changesets import applied

CHANGE = "scope string, seq long, name string, rename_to string, category string, price int, is_new boolean, is_deleted boolean"


def loop(base, changes, categories):
    held, report = {(s, n): [c, p] for s, n, c, p in base}, []
    for scope, seq, name, to, category, price, new, gone in sorted(changes, key=lambda c: c[1]):
        to = None if to == name else to
        key, reason = (scope, name), None
        if category is not None and category not in categories:
            reason = "unknown category"
        elif new and key in held:
            reason = "already there"
        elif not new and key not in held:
            reason = "not there"
        elif to is not None and (scope, to) in held:
            reason = "name taken"
        report.append((seq, name, "skipped" if reason else "added" if new else "deleted" if gone else "kept", reason))
        if reason:
            continue
        if new:
            held[key] = [category, price]
        elif gone:
            del held[key]
        else:
            row = held.pop(key)
            held[(scope, to) if to is not None else key] = [category if category is not None else row[0], price if price is not None else row[1]]
    return sorted(((s, n, c, p) for (s, n), (c, p) in held.items()), key=repr), sorted(report, key=repr)


def both(spark, base, changes):
    b = spark.createDataFrame(base, "scope string, name string, category string, price int")
    c = spark.createDataFrame(changes, CHANGE)
    result, report = applied(b, c, ["food", "drink"], ["scope"])
    return sorted((tuple(r) for r in result.select("scope", "name", "category", "price").collect()), key=repr), sorted((tuple(r)[1:] for r in report.collect()), key=repr)


def entry(seq, name, to=None, category=None, price=None, new=False, gone=False, scope="x"):
    return (scope, seq, name, to, category, price, new, gone)


@pytest.mark.parametrize("seed", range(4))
def test_random_changesets(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(8)]
    base = [(s, n, "food", 1) for s in "xy" for n in names + ["quiet"] if rng.random() < 0.6]
    changes = []
    for seq in range(120):
        kind = rng.random()
        changes.append(entry(seq, rng.choice(names), rng.choice(names) if rng.random() < 0.6 else None, rng.choice([None, "food", "drink", "odd"]), rng.choice([None, rng.randrange(9)]), kind < 0.25, 0.2 < kind < 0.4, rng.choice("xy")))
    assert both(spark, base, changes) == loop(base, changes, ["food", "drink"])


def test_cases(spark):
    base = [("x", n, "food", 1) for n in "abcefk"]
    changes = [
        entry(1, "a", "z"), entry(2, "b", "z"), entry(3, "z", price=7),  # two for one name, then an edit by the new one
        entry(4, "c", price=3), entry(5, "c", category="drink"),  # repeated edits
        entry(6, "d", price=1, new=True), entry(7, "d", price=2, new=True),  # repeated adds
        entry(8, "e", "g"), entry(9, "f", "e"), entry(10, "g", "f"),  # a swap in a ring
        entry(11, "k", gone=True), entry(12, "k", price=5), entry(13, "k", price=6, new=True),  # deleted, missed, added again
    ]
    result, report = both(spark, base, changes)
    assert (result, report) == loop(base, changes, ["food", "drink"])
    assert [r[3] for r in sorted(report)] == [None, "name taken", None, None, None, None, "already there", None, None, None, None, "not there", None]


def test_long_chains_and_hot_names(spark):
    base = [("x", "n0", "food", 1), ("x", "hot", "food", 1)]
    chain = [entry(k, f"n{k}", f"n{k + 1}", price=k) for k in range(20)]
    hot = [entry(100 + k, "hot", price=k) for k in range(200)] + [entry(400 + k, "n20", "hot") for k in range(200)]
    assert both(spark, base, chain + hot) == loop(base, chain + hot, ["food", "drink"])


def test_nothing(spark):
    assert both(spark, [], []) == ([], [])
    assert both(spark, [("x", "a", None, None)], []) == ([("x", "a", None, None)], [])
