"""What is published: live rows, applied matches, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergestone.functions.classify import consistent_category
from mergestone.operators import fusion as U
from mergestone.operators.snapshots import PER, pieces


def live_rows(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """FIL5: active children of active parents."""
    return children.filter("is_active").join(parents.filter("is_active").select(key), key, "left_semi")


def synced_tags(held: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """FUS8: tags (item, code, kind) in which those of one kind are replaced for the items that ``new`` (item, code) speaks of."""
    spoken = new.select("item").distinct()
    kept = held.filter(F.col("kind") != kind).unionByName(held.filter(F.col("kind") == kind).join(spoken, "item", "left_anti"))
    return kept.unionByName(new.filter("code is not null").select("item", "code", F.lit(kind).alias("kind")))


def applied_matches(matches: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FUS9: (links, entities). A match (record, block, key, outcome, entity) that is new names its entity by a hash of its natural
    key, so reruns give the same one; candidates (record, source, rank, observed_at, name, category, tags) of all its records
    are fused by priority, and the category is made to fit the tags. Records under review link to nothing yet."""
    fresh = F.xxhash64("block", "key")
    links = matches.filter("outcome <> 'review'").select("record", F.when(F.col("outcome") == "auto_merge", F.col("entity")).otherwise(fresh).alias("entity"), (F.col("outcome") == "new_entity").alias("created"))
    c = links.join(payloads, "record").select("entity", F.lit("all").alias("field"), F.col("record").alias("ref"), "source", "rank", "observed_at", F.struct("name", "category", "tags").alias("value"))
    w = U.fused(c, U.by_priority())
    return links, w.select("entity", F.col("value.name").alias("name"), consistent_category(F.col("value.category"), F.col("value.tags")).alias("category"), F.col("n").alias("n_records"))


def file_snapshot(parents: DataFrame, children: DataFrame) -> DataFrame:
    """PUB2, JOI14: of parents (position, name, is_active) the first of each trimmed name, if active, with its active children
    (name, parent, is_active) in order; a retired parent drops its children."""
    first = parents.withColumn("name", F.trim("name")).withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("position"))).filter("k = 1 and is_active")
    kids = children.filter("is_active").groupBy(F.trim("parent").alias("name")).agg(F.array_sort(F.collect_list(F.col("name"))).alias("items"))
    return first.join(kids, "name", "left").select("position", "name", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def file_snapshot_pieces(parents: DataFrame, children: DataFrame, per: int = PER) -> DataFrame:
    """PUB2 for parents of any size: the documents of ``file_snapshot`` as numbered pieces of text, by name."""
    w = Window.partitionBy("name").orderBy("position")
    first = parents.withColumn("name", F.trim("name")).withColumn("k", F.row_number().over(w)).filter("k = 1 and is_active").select("name", F.col("name").alias("brand"), "position")
    kids = children.filter("is_active").select(F.trim("parent").alias("name"), F.col("name").alias("item"))
    return pieces(first, {"items": kids}, "name", {"items": ["item"]}, per)
