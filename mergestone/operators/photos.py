"""Attachment and attribution of photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergestone.functions.text import host_key, similarity


def guide_score(full: Column, head: Column, name: Column) -> Column:
    """PHO2: the better similarity of a caption or its head; a name that begins the caption, or three or more words that are
    all in it, scores 90 at least."""
    words = lambda c: F.split(c, " ")
    subset = (F.size(words(name)) >= 3) & (F.size(F.array_except(words(name), words(full))) == 0)
    rule = F.when(full.startswith(F.concat(name, F.lit(" "))) | subset, 90.0).otherwise(0.0)
    return F.greatest(similarity(full, name), similarity(head, name), rule)


def first_claims(photos: DataFrame) -> DataFrame:
    """WIN7, PHO1: of photos (photo, parent, dish, season, position) the newest season's first for each dish."""
    return photos.groupBy("parent", "dish").agg(F.max_by(F.struct("photo", "season", "position"), F.struct("season", -F.col("position"), -F.col("photo"))).alias("p")).select("parent", "dish", "p.*")


def outcome(parent_matched: Column, dish_matched: Column, has_photo: Column) -> Column:
    """PHO1: four buckets."""
    return F.when(~parent_matched, "no_parent").when(~dish_matched, "no_dish").when(has_photo, "has_photo").otherwise("attached")


def two_stage(photos: DataFrame, own: DataFrame, menu: DataFrame) -> DataFrame:
    """PHO3 over scored pairs: (photo, dish, score) inside the photo's own parent first; else over the whole menu if the best is
    the only one. Matches of the first stage keep a dish that both claim."""
    best = lambda s: s.filter("score >= 90").groupBy("photo").agg(F.max("score").alias("score"), F.max_by("dish", F.struct("score", -F.col("dish"))).alias("dish"))
    first = best(own).select("photo", "dish", F.lit(1).alias("stage"))
    wide = best(menu)
    ties = menu.join(wide.select("photo", F.col("score").alias("top")), "photo").filter("score = top").groupBy("photo").count().filter("count = 1")
    second = wide.join(ties, "photo", "left_semi").join(first, "photo", "left_anti").join(first, "dish", "left_anti").select("photo", "dish", F.lit(2).alias("stage"))
    claims = first.unionByName(second)
    return claims.groupBy("dish").agg(F.min(F.struct("stage", "photo")).alias("c")).select("c.photo", "dish", "c.stage")


def may_replace(via: Column, season: Column, new_season: Column) -> Column:
    """PHO4: foreign photos stay; own ones give way to newer seasons only; a dish without one takes any."""
    return F.when(via.isNull(), True).when(via != "own", False).otherwise(new_season > season)


def promoted(candidates: DataFrame, season: int) -> DataFrame:
    """PHO5: items (item) whose served photo is curated, not published by hand and not of this season, while a crawled one of this
    season exists: their stale curated candidates are dropped. Rows (item, ref, curated, by_hand, season, served)."""
    stale = F.col("curated") & ~F.col("by_hand") & (F.col("season") < season)
    flags = candidates.groupBy("item").agg(F.bool_or(F.col("served") & stale).alias("old"), F.bool_or(~F.col("curated") & (F.col("season") == season)).alias("fresh"))
    out = candidates.join(flags, "item")
    return out.filter(~(F.col("old") & F.col("fresh") & stale)).drop("old", "fresh")


def attributed(items: DataFrame, candidates: DataFrame, records: DataFrame, credits: DataFrame) -> DataFrame:
    """PHO6, JOI10, STR16: an item's served value is attributed to the first candidate of equal value, through its record to a page,
    whose host gives the credit; unknown hosts are their own. Rows (item, value), (item, value, ref), (ref, url), (host, credit)."""
    first = candidates.groupBy("item", "value").agg(F.min("ref").alias("ref"))
    out = items.join(first, ["item", "value"], "left").join(records, "ref", "left")
    url = F.when(F.col("url").rlike("^https?://"), F.col("url"))
    out = out.select("item", "value", "ref", url.alias("url")).withColumn("host", F.when(F.col("url").isNotNull(), host_key(F.col("url"))))
    return out.join(credits, "host", "left").withColumn("credit", F.coalesce("credit", "host"))


def reconciled_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """PHO8: manifest ids with the first returned file by name, or none; files are (path), their stem being the id."""
    stem = F.regexp_extract("path", r"([^/]+?)\.[A-Za-z0-9]+$", 1)
    first = files.groupBy(stem.alias("public_id")).agg(F.min("path").alias("path"))
    return manifest.join(first, "public_id", "left").withColumn("returned", F.col("path").isNotNull())
