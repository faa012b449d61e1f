"""Triage of open conflicts into proposals: rows (id, values array<struct<rank, value>>) and the like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AUTO_APPLY = 0.85
MIDDLE, PARENT_LEAST, PARENT_GAP, MOST = 80.0, 75.0, 15.0, 0.8


def numeric_outliers(conflicts: DataFrame, share: float = 0.2) -> DataFrame:
    """TRI1, AGG14: values within ``share`` of the median agree; if more agree than disagree, and one does disagree, the agreeing
    value of the best rank is proposed. Fewer than two values go to a person. Rows (id, rank, value)."""
    m = conflicts.groupBy("id").agg(F.median("value").alias("m"), F.count("*").alias("n"))
    marked = conflicts.join(m, "id").withColumn("agrees", F.abs(F.col("value") - F.col("m")) <= share * F.abs(F.col("m")))
    g = marked.groupBy("id").agg(F.max("n").alias("n"), F.count_if("agrees").alias("agree"), F.min_by(F.when(F.col("agrees"), F.col("value")), F.when(F.col("agrees"), F.struct("rank", "value"))).alias("best"))
    found = (F.col("n") >= 2) & (F.col("agree") > F.col("n") - F.col("agree")) & (F.col("n") > F.col("agree"))
    return g.select("id", "n", "agree", F.when(found, F.col("best")).alias("proposal"), F.when(found, F.lit(0.9)).alias("confidence"))


def text_variants(conflicts: DataFrame) -> DataFrame:
    """TRI2 over (id, rank, value, key): equal keys propose the value of the best rank; a longest one that holds all others, itself
    (of equals that of the best rank, then the largest value and key)."""
    longest = F.struct(F.length("key"), -F.col("rank"), "value", "key")
    g = conflicts.groupBy("id").agg(F.min_by("value", F.struct("rank", "value")).alias("best"), F.max_by("value", longest).alias("longest"), F.max_by("key", longest).alias("longest_key"), F.count_distinct("key").alias("n_keys"), F.count("*").alias("n"))
    holds = conflicts.join(g, "id").groupBy("id").agg(F.min(F.col("longest_key").contains(F.col("key"))).alias("holds"))
    out = g.join(holds, "id")
    same, whole = (F.col("n") >= 2) & (F.col("n_keys") == 1), (F.col("n") >= 2) & F.col("holds")
    return out.select("id", F.when(same, F.col("best")).when(whole, F.col("longest")).alias("proposal"), F.when(same, 0.95).when(whole, 0.7).alias("confidence"))


def score_band(score: Column) -> tuple[Column, Column]:
    """TRI3: (proposal, confidence) of a score in the review band."""
    c = F.least(0.5 + 0.3 * F.abs(score - MIDDLE) / 10, F.lit(MOST))
    return F.when(score >= MIDDLE, "match").otherwise("new_entity"), c


def parent_reference(scores: DataFrame) -> DataFrame:
    """TRI4, WIN8: over (id, parent, score): best and runner-up; a clear best is a match."""
    best_first = Window.partitionBy("id").orderBy(F.col("score").desc(), "parent")
    # two rows of an id, at most, leave a task
    two = scores.withColumn("k", F.row_number().over(best_first)).filter("k <= 2")
    top = two.groupBy("id").agg(F.max(F.when(F.col("k") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("k") == 1, F.col("parent"))).alias("first"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("second"))
    best, gap = F.col("score"), F.col("score") - F.coalesce("second", F.lit(0.0))
    clear = (best >= PARENT_LEAST) & (gap >= PARENT_GAP)
    return top.select("id", "score", gap.alias("gap"), F.when(clear, F.col("first")).alias("parent"), F.when(clear, F.least(0.5 + (best - PARENT_LEAST) / 50, F.lit(MOST))).alias("confidence"))


def dispatched(proposals: DataFrame) -> DataFrame:
    """TRI5: a sure field value resolves itself, other proposals are suggested, the rest stays open. Rows (kind, confidence)."""
    c = F.col("confidence")
    return proposals.withColumn("status", F.when((F.col("kind") == "field_value") & (c >= AUTO_APPLY), "resolved").when(c.isNotNull(), "suggested").otherwise("open"))


def decided(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """TRI6: suggested conflicts that were accepted are resolved, rejected ones dismissed for good."""
    d = F.col("decision")
    s = F.when((F.col("status") == "suggested") & (d == "accept"), "resolved").when((F.col("status") == "suggested") & (d == "reject"), "dismissed").otherwise(F.col("status"))
    return conflicts.join(decisions, "id", "left").withColumn("status", s).drop("decision")


def proposed_by(conflicts: DataFrame, resolvers: list) -> DataFrame:
    """UDF6: resolvers are functions from conflicts to proposals (id, proposal, confidence); the surest wins, then the first."""
    every = None
    for k, resolver in enumerate(resolvers):
        p = resolver(conflicts).select("id", F.col("proposal").cast("string").alias("proposal"), F.col("confidence").cast("double").alias("confidence"), F.lit(-k).alias("k")).filter("confidence is not null")
        every = p if every is None else every.unionByName(p)
    return every.groupBy("id").agg(F.max_by(F.struct("proposal", "confidence"), F.struct("confidence", "k")).alias("p")).select("id", "p.*")
