"""Pieces of nested documents, put together, against documents written at once."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from mergestone.operators import snapshots as S


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    parents = [(k, f"p{k} \"x\"", None if k % 3 else k) for k in range(8)]
    kids = [(0 if rng.random() < 0.6 else rng.randrange(1, 7), rng.randrange(40), None if rng.random() < 0.2 else "né, ]}") for _ in range(300)] + [(99, 1, "lost"), (None, 1, "lost")]
    p = spark.createDataFrame(parents, "k long, name string, zone long")
    c = spark.createDataFrame(kids, "k long, at long, label string")
    return parents, kids, p, c


def built(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["k"], r["segment"], r["piece"])):
        out[r["k"]] = out.get(r["k"], "") + r["text"]
    return out


@pytest.mark.parametrize("per", [1, 7, 1000])
def test_pieces_are_the_document(tables, per):
    parents, kids, p, c = tables
    rows = S.pieces(p, {"items": c, "also": c.filter("at < 5")}, "k", {"items": ["at", "label"], "also": ["at", "label"]}, per).collect()
    assert all(r["text"].count('"at":') <= per for r in rows)
    got = built(rows)
    first = lambda x: (x["at"], x["label"] is not None, x["label"] or "")
    for k, name, zone in parents:
        mine = sorted(({"at": a, "label": b} for key, a, b in kids if key == k), key=first)
        want = {"also": [x for x in mine if x["at"] < 5], "items": mine, "name": name, "zone": zone}
        assert got[k] == json.dumps(want, separators=(",", ":"), ensure_ascii=False), k
    assert set(got) == set(range(8))


def test_list_as_last_name_and_alone(spark, tables):
    _, kids, p, c = tables
    got = built(S.pieces(p.select("k"), {"zz": c}, "k", {"zz": ["at", "label"]}, 9).collect())
    assert {k: len(json.loads(v)["zz"]) for k, v in got.items()} == {k: sum(x[0] == k for x in kids) for k in range(8)}
    none = S.pieces(p.limit(0), {"zz": c}, "k", {"zz": ["at"]}).collect()
    assert none == []
    empty = built(S.pieces(p.select("k", "zone"), {"a": c.limit(0)}, "k", {"a": ["at"]}).collect())
    assert json.loads(empty[1]) == {"a": [], "zone": None}


def test_places_of_a_hot_key(spark, tables):
    _, kids, _, c = tables
    rows = S.numbered(c.filter("k is not null"), "k", ["at"]).collect()
    for k in {x[0] for x in kids if x[0] is not None}:
        mine = sorted((r["place"], r["at"]) for r in rows if r["k"] == k)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1] for m in mine] == sorted(m[1] for m in mine)


def test_written_and_read_again(spark, tables, tmp_path):
    _, kids, p, c = tables
    S.write_snapshot(S.pieces(p, {"items": c}, "k", {"items": ["at", "label"]}, 7), "k", str(tmp_path / "s"))
    back = spark.read.schema("k long, segment int, piece long, text string, ends int").json(str(tmp_path / "s"))
    got = sorted(map(tuple, S.read_list(back, "k", "items", "at long, label string").collect()), key=repr)
    assert got == sorted((x for x in kids if x[0] is not None and x[0] < 8), key=repr)


def test_children_that_end_like_a_list(spark, tables):
    _, kids, p, c = tables
    rows = S.pieces(p.select("k"), {"items": c.withColumn("marks", F.array("at", "at"))}, "k", {"items": ["at", "label"]}, 3)
    got = S.read_list(rows, "k", "items", "at long, marks array<long>")
    assert got.filter("marks[1] = at").count() == sum(x[0] is not None and x[0] < 8 for x in kids)


def test_etags_see_values_not_order(spark, tables):
    _, _, p, c = tables
    one = dict(map(tuple, S.etags(p, {"items": c}, "k").collect()))
    assert one == dict(map(tuple, S.etags(p, {"items": c.orderBy(F.desc("at"))}, "k").collect()))
    other = dict(map(tuple, S.etags(p, {"items": c.withColumn("label", F.when(F.col("k") == 2, "x").otherwise(F.col("label")))}, "k").collect()))
    assert {k for k in one if one[k] != other[k]} == {2}
    assert len(set(one.values())) == 8 and all(len(v) == 32 for v in one.values())
    assert hashlib.sha256(b"").hexdigest()[:32] not in one.values()
