"""Support, retirement and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def supported(links: DataFrame, live_pages: DataFrame, excluded_sources: DataFrame) -> DataFrame:
    """LIF1, JOI4, JOI5: entities with a link to a live page of a source that is not excluded."""
    return links.join(live_pages, "page", "left_semi").join(excluded_sources, "source", "left_anti").select("entity").distinct()


def judged(entities: DataFrame, support: DataFrame, force: bool = False, most: float = 0.6) -> DataFrame:
    """LIF2-LIF5 over (entity, parent, curated, is_active): the new is_active of every entity, or the old one where the pass is
    refused: when all active entities would be lost (whatever ``force`` says), or more than ``most`` of them without it. The
    verdict is one aggregate row that the update depends on, so it is all or nothing."""
    s = support.withColumn("has_support", F.lit(True))
    wanted = entities.join(s, "entity", "left").withColumn("wanted", F.col("curated") | F.coalesce("has_support", F.lit(False)))
    live = F.col("is_active")
    lost = F.count_if(live & ~F.col("wanted"))
    verdict = wanted.agg(((F.count_if(live) > 0) & (lost == F.count_if(live)) | (F.lit(not force) & (lost > most * F.count_if(live)))).alias("refused"))
    refused = verdict.scalar()
    out = wanted.withColumn("refused", refused)
    now = F.when(F.col("refused"), live).otherwise(F.col("wanted"))
    change = F.when(live & ~now, "retired").when(~live & now, "reactivated").when(now, "kept").otherwise("stays_retired")
    return out.select("entity", "parent", "curated", live.alias("was_active"), now.alias("is_active"), change.alias("change"), "refused")


def follow_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """LIF3: children are active only under an active parent."""
    p = parents.filter("is_active").select(F.col("entity").alias("parent"))
    return children.join(p.withColumn("there", F.lit(True)), "parent", "left").withColumn("is_active", F.col("is_active") & F.coalesce("there", F.lit(False))).drop("there")


def judged_together(parents: DataFrame, children: DataFrame, parent_support: DataFrame, child_support: DataFrame, force: bool = False, most: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """LIF2-LIF5 over parents (entity, curated, is_active) and children (entity, parent, curated, is_active), with one verdict for both:
    the new is_active of all rows, or the old one of all.

    ``curated`` rows (made by hand, or with an is_active whose selected value is a curated source's) are not judged and keep theirs. A judged parent
    is wanted if it has support; a judged child if it has support and its parent is wanted, or is curated and active. The pass is refused
    if all active judged parents or all active judged children would be lost, whatever ``force`` says, or without it more than ``most``
    of the parents; children turn over with the season, so no share of them is too large. Null flags count as false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    yes = lambda df: df.select("entity").distinct().withColumn("has", F.lit(True))
    p = parents.select("entity", flag("curated"), flag("is_active")).join(yes(parent_support), "entity", "left")
    p = p.withColumn("wanted", ~F.col("curated") & F.coalesce("has", F.lit(False))).drop("has")
    hosts = p.filter("wanted or curated and is_active").select(F.col("entity").alias("parent"), F.lit(True).alias("host"))
    c = children.select("entity", "parent", flag("curated"), flag("is_active")).join(yes(child_support), "entity", "left").join(hosts, "parent", "left")
    c = c.withColumn("wanted", ~F.col("curated") & F.coalesce(F.col("has") & F.col("host"), F.lit(False))).select("entity", "parent", "curated", "is_active", "wanted")

    judged_now = F.col("is_active") & ~F.col("curated")
    counts = lambda df, share: df.agg(F.count_if(judged_now).alias("n"), F.count_if(judged_now & ~F.col("wanted")).alias("lost")).select(((F.col("n") > 0) & (F.col("n") == F.col("lost")) | (F.lit(share and not force) & (F.col("lost") > most * F.col("n")))).alias("refused"))
    # both halves' counts are one row, on which both updates depend
    refused = counts(p, True).unionByName(counts(c, False)).agg(F.bool_or("refused").alias("refused")).scalar()
    now = F.when(F.col("curated") | F.col("refused"), F.col("is_active")).otherwise(F.col("wanted"))
    was = F.col("is_active")
    change = F.when(was & ~F.col("now"), "retired").when(~was & F.col("now"), "reactivated").when(F.col("now"), "kept").otherwise("stays_retired")
    done = lambda df, *keys: df.withColumn("refused", refused).withColumn("now", now).select(*keys, "curated", was.alias("was_active"), F.col("now").alias("is_active"), change.alias("change"), "refused")
    return done(p, "entity"), done(c, "entity", "parent")


def loss_guard(before: DataFrame, after: DataFrame, declared: DataFrame, floor: int = 5, share: float = 0.1) -> DataFrame:
    """GRD2, SET4, JOI16: one row (n_before, n_lost, allowed, refused): rows lost without a declared deletion may not exceed
    max(floor, share of what there was), and a set may not be emptied."""
    lost = before.join(after, "id", "left_anti").join(declared, "id", "left_anti").agg(F.count("*").alias("n_lost"))
    counts = before.agg(F.count("*").alias("n_before"))
    left = after.agg(F.count("*").alias("n_after")).scalar()
    allowed = F.greatest(F.lit(floor), F.floor(F.col("n_before") * share).cast("int"))
    return counts.withColumn("n_lost", lost.scalar()).withColumn("n_after", left).withColumn("allowed", allowed.cast("long")).withColumn("refused", (F.col("n_lost") > F.col("allowed")) | ((F.col("n_after") == 0) & (F.col("n_before") > 0))).drop("n_after")


def inventory_problems(items: DataFrame, parents: DataFrame) -> DataFrame:
    """GRD1 over (id, public_id, parent): rows (id, problem)."""
    many = items.filter("public_id is not null").groupBy("public_id").count().filter("count > 1").select("public_id")
    missing = items.filter("public_id is null").select("id", F.lit("missing public_id").alias("problem"))
    repeated = items.join(many, "public_id", "left_semi").select("id", F.lit("duplicate public_id").alias("problem"))
    orphan = items.join(parents.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", F.lit("no parent").alias("problem"))
    return missing.unionByName(repeated).unionByName(orphan)


def unheld(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """JOI6, JOI7, ER7, UPS5: rows whose key isn't held yet, so that a repeated pass adds nothing."""
    return wanted.join(held.select(key).distinct(), key, "left_anti")


def staged(lists: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """UPS5: of lists (key, n, digest) those whose digest isn't among the ``held`` (key, digest, version) of their key, as the key's next
    version. Staging a list again adds nothing, a changed one adds a version, and one that goes back to an earlier state is held."""
    last = held.groupBy(key).agg(F.max("version").alias("last"))
    new = lists.join(held.select(key, "digest").distinct(), [key, "digest"], "left_anti")
    return new.join(last, key, "left").select(key, "n", "digest", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("version"))


def upserted(table: DataFrame, new: DataFrame, key: str, update: bool) -> DataFrame:
    """SRC9: insert-or-ignore, or insert-or-update, by key."""
    if update:
        return table.join(new, key, "left_anti").unionByName(new)
    return table.unionByName(new.join(table, key, "left_anti"))
