"""Keyed state by event time, and batches that are repeated."""

import random

import pytest
from pyspark.sql import functions as F

from mergestone.streaming import changes as S
from mergestone.streaming import settled as T

FETCH = "url long, at string, fetch_id long, hash string"


def arrivals(spark, folder, rows):
    spark.createDataFrame(rows, FETCH).select("url", F.col("at").cast("timestamp").alias("fetched_at"), "fetch_id", "hash").coalesce(1).write.mode("append").parquet(folder)


def versions(spark, folder, out, delay="2 days", forget=None):
    stream = spark.readStream.schema("url long, fetched_at timestamp, fetch_id long, hash string").option("maxFilesPerTrigger", 1).parquet(folder)
    rows = S.run_to_end(T.settled_versions(stream, delay, forget), "settled", folder=out).collect()
    return sorted(((r["url"], r["version"], r["fetch_id"], r["hash"], r["late"]) for r in rows), key=repr)


def day(n, hour=0):
    return f"2024-01-{n:02d} {hour:02d}:00:00"


def test_order_of_arrival_does_not_count_and_a_restart_goes_on(spark, tmp_path):
    rng = random.Random(1)
    rows = [(u, day(1 + k // 4, k % 4), 100 * u + k, rng.choice("ab")) for u in (1, 2) for k in range(20)]
    want = []
    for u in (1, 2):
        n, last = 0, None
        for r in (r for r in rows if r[0] == u):
            if r[3] != last:
                n, last = n + 1, r[3]
                want.append((u, n, r[2], r[3], False))
    rng.shuffle(rows)
    arrivals(spark, f"{tmp_path}/in", rows[:13])
    versions(spark, f"{tmp_path}/in", f"{tmp_path}/out", "10 days")  # stops in mid-stream, with fetches waiting in the state
    arrivals(spark, f"{tmp_path}/in", rows[13:])
    arrivals(spark, f"{tmp_path}/in", [(9, "2030-01-01", 1, "x")])
    assert versions(spark, f"{tmp_path}/in", f"{tmp_path}/out", "10 days") == sorted(want, key=repr)


def test_late_fetches_are_told_apart(spark, tmp_path):
    for rows in ([(1, day(1), 1, "a"), (1, day(9), 2, "b")], [(1, day(2), 3, "z"), (2, day(3), 4, "y"), (1, day(8), 5, "c")], [(9, "2030-01-01", 6, "x")]):
        arrivals(spark, f"{tmp_path}/in", rows)
    got = versions(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert [r for r in got if r[4]] == [(1, None, 3, "z", True), (2, None, 4, "y", True)]
    assert [r for r in got if not r[4]] == [(1, 1, 1, "a", False), (1, 2, 5, "c", False), (1, 3, 2, "b", False)]


@pytest.mark.parametrize("forget, number", [(None, 2), (5, 1)])
def test_state_expires(spark, tmp_path, forget, number):
    for rows in ([(1, "2024-01-01", 1, "a")], [(2, "2024-03-01", 2, "x")], [(2, "2024-03-02", 3, "x")], [(1, "2024-03-03", 4, "b")], [(9, "2030-01-01", 5, "x")]):
        arrivals(spark, f"{tmp_path}/in", rows)
    got = versions(spark, f"{tmp_path}/in", f"{tmp_path}/out", forget=forget)
    assert (1, number, 4, "b", False) in got


def test_repeated_and_failed_batches_count_once(spark, tmp_path):
    ledger = T.Ledger(spark, f"{tmp_path}/ledger", "k long, at long, v string", "k", ["at"])
    frame = lambda *rows: spark.createDataFrame(rows, "k long, at long, v string")
    assert ledger.table().count() == 0
    assert ledger.take(frame((1, 1, "a"), (1, 3, "b"), (2, 1, "c"), (None, 1, "n")), 0)

    def fails():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        ledger.take(frame((2, 5, "half")), 1, between=fails)
    assert sorted(tuple(r) for r in ledger.table().collect()) == [(1, 3, "b"), (2, 1, "c")]  # a part without its ledger entry does not count
    assert ledger.take(frame((2, 6, "whole"), (3, 1, "d")), 1)
    assert not ledger.take(frame((1, 9, "again")), 0)
    assert sorted(tuple(r) for r in ledger.table().collect()) == [(1, 3, "b"), (2, 6, "whole"), (3, 1, "d")]
    assert sorted(tuple(r) for r in ledger.batches().collect()) == [(0, 2), (1, 2)]


def test_stream_into_a_ledger(spark, tmp_path):
    for k in range(3):
        spark.range(k, 10 + k).select("id", F.lit(k).cast("long").alias("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ledger = T.Ledger(spark, f"{tmp_path}/ledger", "id long, at long", "id", ["at"])
    stream = spark.readStream.schema("id long, at long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run has nothing to take
        ledger.run(stream, f"{tmp_path}/checkpoint")
    assert {r["id"]: r["at"] for r in ledger.table().collect()} == {i: min(i, 2) if i >= 10 else max(k for k in range(3) if k <= i) for i in range(12)}
    assert ledger.batches().count() == 3
