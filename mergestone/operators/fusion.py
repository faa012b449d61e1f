"""Fusion of conflicting field values. Candidates are rows (entity, field, ref, source, rank, observed_at, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["entity", "field"]


def by_priority() -> Column:
    """Orders candidates for max_by: lowest rank, then most recent, then lowest ref (WIN5); of equals the largest source and
    value, so that the outcome never depends on the order of rows."""
    return F.struct(-F.col("rank"), F.col("observed_at"), -F.col("ref"), "source", "value")


def by_recency() -> Column:
    """WIN6: latest observed, then lowest ref, then as above."""
    return F.struct(F.col("observed_at"), -F.col("ref"), "source", "value")


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """FUS2: one candidate for each (entity, field, source, ref): the earliest observed, and of those the least rank
    and value."""
    return candidates.groupBy(*KEY, "source", "ref").agg(F.min_by(F.struct("rank", "observed_at", "value"), F.struct("observed_at", "rank", "value")).alias("c")).select(*KEY, "source", "ref", "c.*")


def fused(candidates: DataFrame, order: Column) -> DataFrame:
    """FUS3 in one aggregation that combines before its shuffle: (entity, field, value, ref, source, rank, n)."""
    best = F.max_by(F.struct("value", "ref", "source", "rank"), order)
    return candidates.groupBy(*KEY).agg(best.alias("w"), F.count("*").alias("n")).select(*KEY, "w.*", "n")


def union_fused(candidates: DataFrame) -> DataFrame:
    """FUS4, AGG12 over array values: all members in order of first occurrence by (rank, ref); if a curated candidate (rank 0)
    exists, the latest of those replaces the union. Members are deduplicated before they are gathered, and the latest curated
    value comes along in the same two aggregations."""
    members = candidates.withColumn("curated", F.when(F.col("rank") == 0, F.struct(by_recency().alias("order"), "value"))).select(*KEY, "rank", "ref", "curated", F.posexplode_outer("value").alias("at", "member"))
    first = members.groupBy(*KEY, "member").agg(F.min(F.struct("rank", "ref", "at")).alias("first"), F.max("curated").alias("curated"))
    joined = first.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.when(F.col("member").isNotNull(), F.struct("first", "member")))).alias("m"), F.max("curated").alias("c"))
    return joined.select(*KEY, F.coalesce("c.value", F.transform("m", lambda x: x["member"])).alias("value"), F.col("c.value").isNotNull().alias("is_curated"))


def selected(candidates: DataFrame, order: Column) -> DataFrame:
    """FUS5: candidates with is_selected, true for the first of each (entity, field) in ``order``, and for one of equal rows."""
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy(order.desc()))
    return candidates.withColumn("is_selected", at == 1)


def disagreement(candidates: DataFrame, order: Column, numeric: bool, share: float = 0.2) -> DataFrame:
    """FUS6, MAT2: (entity, field, n_values, disagrees). Numbers disagree if any differs from the winner in ``order`` by more than
    ``share`` of it (from a winner of zero, if any is not zero); strings if there is more than one. The least and the largest
    value decide it, so one aggregation does."""
    c = candidates.groupBy(*KEY).agg(F.count("value").alias("n_values"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", order).alias("w")).filter("n_values > 0")
    if numeric:
        far = F.when(F.col("w") == 0, (F.col("low") != 0) | (F.col("high") != 0)).otherwise(F.greatest(F.col("w") - F.col("low"), F.col("high") - F.col("w")) > share * F.abs(F.col("w")))
    else:
        far = F.when(F.col("w").isNotNull(), F.col("low") != F.col("high"))
    return c.select(*KEY, "n_values", (F.coalesce(far, F.lit(False)) & (F.col("n_values") >= 2)).alias("disagrees"))


def by_source(candidates: DataFrame) -> DataFrame:
    """AGG11: the last value of each source as a map, and its size."""
    last = candidates.groupBy(*KEY, "source").agg(F.max_by("value", F.struct("observed_at", "ref", "value")).alias("value"))
    return last.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "value")))).alias("values"))


def conflict_changes(wanted: DataFrame, open_conflicts: DataFrame) -> DataFrame:
    """FUS7: what becomes of conflicts (entity, field): opened, updated, resolved or unchanged."""
    both = wanted.select(*KEY, "disagrees").join(open_conflicts.select(*KEY).distinct().withColumn("was_open", F.lit(True)), KEY, "full")
    now, was = F.coalesce("disagrees", F.lit(False)), F.coalesce("was_open", F.lit(False))
    action = F.when(now & was, "updated").when(now, "opened").when(was, "resolved").otherwise("unchanged")
    return both.select(*KEY, action.alias("action"))


def long_candidates(records: DataFrame, fields: dict[str, str], keys: list[str]) -> DataFrame:
    """FUS1 from records with a ``payload`` map: each mapped key with a value is a candidate; a null counts where the key is
    there and the record is curated (rank 0)."""
    out = None
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(f).alias("field")) for k, f in fields.items()))
    out = records.withColumn("p", F.explode(pairs)).withColumn("value", F.try_element_at("payload", F.col("p.key")))
    there = F.map_contains_key("payload", F.col("p.key"))
    return out.filter(F.col("value").isNotNull() | (there & (F.col("rank") == 0))).select(*keys, F.col("p.field").alias("field"), "value")
