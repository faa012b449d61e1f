"""Every registered query of the integration engine against the SQL that states its result."""

import glob
import os

import duckdb
import pytest

from mergestone.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = [os.path.basename(p)[:-8] for p in glob.glob(f"{SF}/*.parquet")]


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v.item() if hasattr(v, "item") else v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in Q.ORACLE:
        cur = duck.execute(Q.ORACLE[name])
        cols = [d[0] for d in cur.description]
        want = rows(cols, cur.fetchall())
        assert sorted(df.columns) == sorted(cols)
        assert len(got) == len(want)
        wrong = [(g, w) for g, w in zip(got, want) if g != w]
        assert not wrong, (len(wrong), wrong[:3])
