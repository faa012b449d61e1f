"""Urls that share a bucket of state keep versions of their own, and a stream of many urls is few calls."""

import random

import pytest
from pyspark.sql import functions as F

from mergestone.streaming import changes as S
from mergestone.streaming import settled as T

FETCH = "url long, fetched_at timestamp, fetch_id long, hash string"


def write(spark, folder, rows):
    spark.createDataFrame(rows, "url long, at long, fetch_id long, hash string").select("url", F.timestamp_seconds("at").alias("fetched_at"), "fetch_id", "hash").coalesce(1).write.mode("append").parquet(folder)


def plan(rows):
    out, known = [], {}
    for url, at, fetch_id, now in rows:
        n, last = known.get(url, (0, None))
        if n == 0 or now != last:
            n, last = n + 1, now
            out.append((url, n, fetch_id, now))
        known[url] = (n, last)
    return out


def in_time(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def fetches(rng, urls, n):
    return [(rng.choice(urls), rng.randrange(1000), k, rng.choice(["a", "b", None])) for k in range(n)]


def test_changes_across_batches_of_one_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 3)
    rng, urls = random.Random(2), [None, *range(9), 2**60, 2**60 + 1]
    parts = [fetches(rng, urls, 80), [(u, at, 100 + k, h) for u, at, k, h in fetches(rng, urls, 80)]]
    for p in parts:
        write(spark, f"{tmp_path}/in", p)
    stream = spark.readStream.schema(FETCH).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = [tuple(r) for r in S.run_to_end(S.changed_versions(stream), "changes", folder=f"{tmp_path}/out").collect()]
    assert sorted(got, key=repr) == sorted(plan(in_time(parts[0]) + in_time(parts[1])), key=repr)


@pytest.mark.parametrize("n_urls", [5, 40])
def test_settled_versions_of_one_bucket(spark, tmp_path, monkeypatch, n_urls):
    monkeypatch.setattr(S, "BUCKETS", 2)
    rng = random.Random(n_urls)
    rows = fetches(rng, list(range(n_urls)), 150)
    for k in range(3):
        write(spark, f"{tmp_path}/in", rows[50 * k : 50 * k + 50])
    write(spark, f"{tmp_path}/in", [(-1, 10**9, 999, "x")])
    stream = spark.readStream.schema(FETCH).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = [tuple(r) for r in S.run_to_end(T.settled_versions(stream, "2 hours"), "settled", folder=f"{tmp_path}/out").collect()]
    assert sorted(got, key=repr) == sorted(((*r, False) for r in plan(in_time(rows))), key=repr)


def test_keys_of_a_stream_are_dealt_to_a_fixed_number_of_buckets(spark):
    keys = spark.range(5000).withColumnRenamed("id", "url").select(S.bucket_of("url"))
    assert keys.distinct().count() <= S.BUCKETS
