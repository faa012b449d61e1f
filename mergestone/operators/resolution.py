"""Entity resolution: blocked fuzzy matching, banding, and clustering of new records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergestone.functions.text import token_sorted
from mergestone.operators.rounds import kept
from mergestone.operators.similarity_join import similar

AUTO, REVIEW = 90.0, 70.0


def outcome(score: Column) -> Column:
    """ER1"""
    return F.when(score >= AUTO, "auto_merge").when(score >= REVIEW, "review").otherwise("new_entity")


def matched(records: DataFrame, entities: DataFrame, least: float = 0.0) -> DataFrame:
    """ER1-ER3, JOI11, SRT4: each record (record, block, key) with the entity (entity, block, ekey, is_active) of its block that
    scores best, and at least ``least``; live ones win ties, then lower ids. Equal keys of a block are scored once, and keys that the block's
    entities do not hold as they are meet those with enough letters in common. Records without candidates are new entities with a null
    score."""
    keyed = records.withColumn("a", token_sorted(F.col("key")))
    others = entities.select("block", token_sorted(F.col("ekey")).alias("b"), F.struct("is_active", -F.col("entity")).alias("e")).groupBy("block", "b").agg(F.max("e").alias("e"))
    keys = keyed.select("block", "a").distinct()

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.join(others, ["block", "b"]).groupBy("block", "a").agg(F.max(F.struct("score", "e")).alias("b"))

    # nothing scores more than equal keys, so only the others meet their block
    same = keys.join(others.withColumnRenamed("b", "a"), ["block", "a"]).select("block", "a", F.struct(F.lit(100.0).alias("score"), "e").alias("b"))
    found = same.unionByName(best(similar(keys.join(others.select("block", F.col("b").alias("a")), ["block", "a"], "left_anti"), others, least)))
    found = found.select("block", "a", F.col("b.score").alias("score"), (-F.col("b.e.col2")).alias("entity"))
    out = keyed.join(found, ["block", "a"], "left").drop("a")
    return out.withColumn("outcome", outcome(F.col("score"))).withColumn("entity", F.when(F.col("outcome") != "new_entity", F.col("entity")))


def flagged(matches: DataFrame) -> DataFrame:
    """ER5, ER8: attach_only records are dropped unless merged; ``new`` records are new entities unless merged."""
    m = matches.withColumn("outcome", F.when(F.col("new") & (F.col("outcome") != "auto_merge"), "new_entity").otherwise(F.col("outcome")))
    return m.filter(~F.col("attach_only") | (F.col("outcome") == "auto_merge")).withColumn("origin", F.when(F.col("outcome") == "new_entity", F.when(F.col("rank") == 0, "curated").otherwise("crawled")))


def leader_clusters(records: DataFrame) -> DataFrame:
    """ER4, UDF4: exact sequential clustering inside blocks: (record, block, key) -> leader. In the order of records, a key follows the
    leader that is most alike (the earlier of equals) if that scores a sure match, and leads otherwise.

    A key's part follows from the earlier keys near it alone, so all blocks and keys go side by side: in each round, keys with no earlier
    undecided neighbour lead, and their later neighbours follow. Rounds go on while neighbours are undecided; their tables are written to
    the shared folder, each smaller than the last, and so are the records first, since they are read many times and may come from rows that are
    much longer. Records with a null block or key lead themselves."""
    records = kept(records.select("record", "block", "key"), "records")
    nodes = records.filter("block is not null and key is not null").groupBy("block", "key").agg(F.min("record").alias("record")).withColumn("s", token_sorted(F.col("key")))
    first = nodes.groupBy("block", "s").agg(F.min("record").alias("at"))
    near = kept(similar(first.withColumnRenamed("s", "a"), first.withColumnRenamed("s", "b"), AUTO, once=True), "near")
    near = near.unionByName(near.filter("a <> b").select("block", F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    placed = near.filter("a <> b").join(first.select("block", F.col("s").alias("a"), F.col("at").alias("x")), ["block", "a"]).join(first.select("block", F.col("s").alias("b"), F.col("at").alias("y")), ["block", "b"])
    # a key's first record tells it apart from others of its block
    edges = kept(placed.filter("x < y").select("block", "x", "y"), "edges")
    follows = None
    while not edges.isEmpty():
        lead = edges.select("block", "x").distinct().join(edges.select("block", F.col("y").alias("x")).distinct(), ["block", "x"], "left_anti")
        now = kept(edges.join(lead, ["block", "x"], "left_semi").select("block", F.col("y").alias("at")).distinct(), "follow")
        follows = now if follows is None else follows.unionByName(now)
        x, y = now.withColumnRenamed("at", "x"), now.withColumnRenamed("at", "y")
        edges = kept(edges.join(lead, ["block", "x"], "left_anti").join(x, ["block", "x"], "left_anti").join(y, ["block", "y"], "left_anti"), "edges")
    leaders = first if follows is None else first.join(follows, ["block", "at"], "left_anti")
    meets = nodes.withColumnRenamed("s", "a").join(near, ["block", "a"]).join(leaders.withColumnRenamed("s", "b"), ["block", "b"]).filter("at <= record")
    # a table of its own, so that the records of a frequent key can be dealt to several tasks of the join
    led = kept(meets.groupBy("block", "key").agg((-F.max(F.struct("score", (-F.col("at")).alias("at")))["at"]).alias("leader")), "leaders")
    return records.join(led, ["block", "key"], "left").select("record", "block", "key", F.coalesce("leader", "record").alias("leader"))


def longest_prefix_parent(lines: DataFrame, parents: DataFrame) -> DataFrame:
    """JOI15: the parent whose name is the line or its longest prefix that a space or sign follows. Every such prefix of a line
    is a row and joins by equality, so no line meets all parents."""
    ends = F.filter(F.sequence(F.lit(1), F.length("line")), lambda i: (i == F.length("line")) | F.substring("line", i + 1, F.lit(1)).rlike(r"[^\w]"))
    prefixes = lines.select("id", "line", F.explode(F.transform(ends, lambda i: F.substring("line", F.lit(1), i))).alias("name"))
    best = prefixes.join(parents.select("name").distinct(), "name").groupBy("id").agg(F.max_by("name", F.length("name")).alias("parent"))
    return lines.join(best, "id", "left")


def rename_lookup(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """JOI12: an entry (id, block, old, new) matches by its old name, unless the block holds the new one and not the old."""
    e = existing.select("block", "name").distinct()
    has = lambda c, out: e.select("block", F.col("name").alias(c)).withColumn(out, F.lit(True))
    out = entries.join(has("old", "has_old"), ["block", "old"], "left").join(has("new", "has_new"), ["block", "new"], "left")
    return out.select("id", "block", "old", "new", F.when(F.col("has_new") & F.col("has_old").isNull(), F.col("new")).otherwise(F.col("old")).alias("lookup"))
