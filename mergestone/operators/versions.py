"""Versions of captured pages: rows (url, fetched_at, fetch_id, hash)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def versions(fetches: DataFrame) -> DataFrame:
    """WIN1-WIN4, FIL6: one row for each run of equal hashes of a url: version number, first and last fetch, the version that
    replaced it, and whether it is live. One window by url, so one shuffle for all five."""
    w = Window.partitionBy("url").orderBy("fetched_at", "fetch_id")
    changed = F.when(F.lag("hash").over(w).eqNullSafe(F.col("hash")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = fetches.withColumn("changed", changed).withColumn("version", F.sum("changed").over(w))
    runs = numbered.groupBy("url", "version").agg(F.min("hash").alias("hash"), F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_seen_unchanged"), F.min("fetch_id").alias("version_id"), F.count("*").alias("n_fetches"))
    v = Window.partitionBy("url").orderBy("version")
    return runs.withColumn("superseded_by", F.lead("version_id").over(v)).withColumn("is_live", F.col("superseded_by").isNull())


def watermark(runs: DataFrame, as_of: str) -> DataFrame:
    """WIN12: the end of the last successful run, else 30 days before ``as_of``."""
    last = F.max(F.when(F.col("status") == "success", F.col("finished_at")))
    return runs.agg(F.coalesce(last, F.to_date(F.lit(as_of)) - F.expr("interval 30 days")).alias("since"))


def error_stops(fetches: DataFrame, limit: int = 3) -> DataFrame:
    """STM4: by source, the first position at which ``limit`` errors in a row were reached."""
    w = Window.partitionBy("source").orderBy("position")
    runs = fetches.withColumn("island", F.sum(F.when(F.col("error"), 0).otherwise(1)).over(w))
    streak = runs.filter("error").withColumn("streak", F.row_number().over(Window.partitionBy("source", "island").orderBy("position")))
    return streak.filter(F.col("streak") == limit).groupBy("source").agg(F.min("position").alias("stopped_at"))


def positional_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """JOI13, EXT10: the n-th new record of a page and type with the n-th old one; rows (page, kind, record)."""
    w = Window.partitionBy("page", "kind").orderBy("record")
    n = lambda df: df.withColumn("n", F.row_number().over(w))
    return n(new).withColumnRenamed("record", "new_record").join(n(old).withColumnRenamed("record", "old_record"), ["page", "kind", "n"], "left")
