from mergestone.operators import changesets as C


def test_a_round_costs_what_is_left(spark, monkeypatch):
    """A chain of renames, each of which waits for the next entry's name to be taken, beside many plain entries of the same names."""
    kept, sizes = C.kept, []

    def counted(df, name):
        out = kept(df, name)
        if name in ("sure", "decided"):
            sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(C, "kept", counted)
    base = spark.createDataFrame([("n0", "food", 1)], "name string, category string, price int")
    rows = [(i, f"n{i % 8}", None, "food", i, False, False) for i in range(2000)]
    rows += [(2000 + i, f"n{i}", f"n{i + 1}", None, None, False, False) for i in range(8)]
    changes = spark.createDataFrame(rows, "seq long, name string, rename_to string, category string, price int, is_new boolean, is_deleted boolean")
    result, report = C.applied(base, changes, ["food"])
    assert [tuple(r) for r in result.collect()] == [("n8", "food", 1992)]
    assert report.filter("status = 'kept' and rename_to is not null" if "rename_to" in report.columns else "status = 'kept' and seq >= 2000").count() == 8
    left = [n for name, n in sizes if name == "decided"]
    assert len(left) > 3
    assert [name for name, _ in sizes[:2]] == ["sure", "decided"]
    assert all(n <= 2 * m for (name, n), (_, m) in zip(sizes[::2], sizes[1::2]))
