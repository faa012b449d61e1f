"""Asked folders, sessions and sketches on streams, and the native score against the other."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mergestone.functions.text import native_similarity, similarity
from mergestone.sources.keyed_folders import FoldersReader, keyed_folders
from mergestone.streaming import actives as A
from mergestone.streaming.changes import run_to_end

SCHEMA = "key string, a long, b string"


@pytest.fixture
def folders(tmp_path):
    for key, lines in {"x": ['{"a":1,"b":"é"}', "", '{"b":"no a"}'], "y": ['{"a":2}'], "broken": ["{"], "empty": []}.items():
        (tmp_path / key).mkdir()
        (tmp_path / key / "rows.json").write_text("\n".join(lines))
    (tmp_path / "without").mkdir()
    (tmp_path / "x" / "other.txt").write_text("no rows")
    return f"file://{tmp_path}"


def test_only_asked_folders_are_read(spark, folders):
    rows = lambda keys, where="true": sorted(map(tuple, keyed_folders(spark, folders, "rows.json", SCHEMA, keys=keys).filter(where).collect()), key=repr)
    x = [("x", 1, "é"), ("x", None, "no a")]
    assert rows(["x"]) == sorted(x, key=repr)
    assert rows(["x", "y", "none", "y"], "a is not null") == [("x", 1, "é"), ("y", 2, None)]
    assert rows([]) == rows(["empty", "without", "..", "", "../x"]) == []
    with pytest.raises(Exception, match="Expecting property name"):
        rows(None)


def test_a_frame_serves_several_filters(spark, folders):
    df = keyed_folders(spark, folders, "rows.json", SCHEMA, keys=["x", "y"])
    assert df.filter("key = 'x'").count() == 2
    assert df.count() == 3
    assert df.filter("key = 'y'").unionByName(df).count() == 4


def test_partitions_follow_keys(folders):
    keys = lambda k: [p.key for p in FoldersReader(StructType.fromDDL(SCHEMA), folders, "rows.json", "", k).partitions()]
    assert keys(None) == ["broken", "empty", "x", "y"]
    assert keys(["y", "x", "none"]) == ["x", "y"]
    assert keys([]) == [""]


def events(spark, rows):
    at = datetime(2024, 1, 1, 12)
    return spark.createDataFrame([(u, None if s is None else at + timedelta(seconds=s)) for u, s in rows], "user long, at timestamp")


def streamed(spark, folder, schema, *files):
    for rows in files:
        events(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_sessions_of_stream_and_table(spark, tmp_path):
    first, second = [(1, 0), (1, 100), (2, 50), (1, 100)], [(1, 399), (2, 351), (1, 20_000), (1, None)]
    s = streamed(spark, f"{tmp_path}/in", "user long, at timestamp", first, second, [(3, 90_000)], [(1, 30)])
    got = run_to_end(A.sessions(s, "user", "at", late="10 minutes"), "s", folder=f"{tmp_path}/out").filter("user < 3")
    want = A.sessions(events(spark, first + second), "user", "at")
    key = lambda r: (r["user"], r["start"])
    # the event at 30 s came long after its session was given out
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [(r["user"], r["events"]) for r in sorted(want.collect(), key=key)] == [(1, 4), (1, 1), (2, 1), (2, 1)]


def test_sketches_unite_within_their_error(spark):
    day = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") % 5) * 86_400)
    e = spark.range(60_000).select(F.floor(F.col("id") / 3).alias("user"), day.alias("at"))
    sketches = A.daily_sketches(e, "user", "at")
    got = A.actives(sketches, 7).collect()
    assert len(got) == 11
    full = [r["actives"] for r in got if r["until"].day in (5, 6, 7)]
    assert full and all(abs(n - 20_000) <= 4 * A.ERROR * 20_000 for n in full)
    assert A.actives(sketches.limit(0), 7).collect() == []
    assert sketches.select(F.max(F.length("sketch"))).first()[0] < 5000


def test_native_score_equals_the_other(spark):
    names = ["", "a", "rice bowl", "bowl of rice", "crème brûlée", "aaaa aa", "b a c", "éé è", "the long name of a dish 12", None, "🍕 pie", "x" * 60]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    rows = pairs.select("a", "b", native_similarity(F.col("a"), F.col("b")).alias("n"), similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        assert (r["n"] is None) == (r["s"] is None or r["s"] != r["s"]), json.dumps(r.asDict())
        assert r["n"] is None or abs(r["n"] - r["s"]) < 1e-9, json.dumps(r.asDict())
