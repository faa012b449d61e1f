"""Curated overlays and changesets. Payloads are maps from field to text, so that a field that is there without a value differs
from one that is not there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def falsy(c: Column) -> Column:
    return c.isNull() | c.isin("", "0", "false", "[]")


def merged(base: DataFrame, entries: DataFrame, keys: list[str], overwrite: bool, fill: str = "falsy") -> DataFrame:
    """UPS1 (fill="falsy"), UPS2 (fill="absent"), SNK5: full outer merge of (keys, payload) maps. With ``overwrite`` entries win;
    else a field is filled only if it is falsy, or only if it is absent."""
    both = base.withColumnRenamed("payload", "old").join(entries.withColumnRenamed("payload", "new"), keys, "full")
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("old", empty), F.coalesce("new", empty)
    kept = old if fill == "absent" else F.map_filter(old, lambda k, v: ~falsy(v) | ~F.map_contains_key(new, k))
    result = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new) if overwrite else F.map_concat(kept, F.map_filter(new, lambda k, v: ~F.map_contains_key(kept, k)))
    return both.select(*keys, result.alias("payload"), F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "untouched").otherwise("merged").alias("how"))


def changed_fields(base: DataFrame, edited: DataFrame, key: str) -> DataFrame:
    """UPS6, UPS9: minimal edits between two tables of (key, payload): kind added, deleted or edited, and the fields that differ."""
    both = base.withColumnRenamed("payload", "was").join(edited.withColumnRenamed("payload", "now"), key, "full")
    edits = F.map_filter("now", lambda k, v: ~v.eqNullSafe(F.try_element_at("was", k)))
    filled = F.map_filter("now", lambda k, v: v.isNotNull() & (v != ""))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.size(edits) > 0, "edited")
    return both.select(key, kind.alias("kind"), F.when(F.col("was").isNull(), filled).when(F.col("now").isNull(), None).otherwise(edits).alias("fields")).filter("kind is not null")


def lenient_equal(a: Column, b: Column) -> Column:
    """MAT6, SET6: blanks are equal, numbers equal their text, comma lists don't depend on order."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    x, y = blank(a), blank(b)
    parts = lambda c: F.array_sort(F.split(c, r"\s*,\s*"))
    return (x == y) | F.coalesce(x.try_cast("double") == y.try_cast("double"), F.lit(False)) | (parts(x) == parts(y))


def settled(pending: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """UPS7: pending edits (key, field, value, deleted) that the base (key, field, value) does not have yet; pins within 1e-6 count as had."""
    rows = pending.join(base.withColumnRenamed("value", "had"), [key, "field"], "left")
    keys = base.select(key).distinct().withColumn("there", F.lit(True))
    rows = rows.join(keys, key, "left")
    near = F.coalesce(F.abs(F.col("value").try_cast("double") - F.col("had").try_cast("double")) < 1e-6, F.lit(False))
    landed = F.when(F.col("deleted"), F.col("there").isNull()).otherwise(F.col("there").isNotNull() & (lenient_equal(F.col("value"), F.col("had")) | near))
    return rows.filter(~landed).select(key, "field", "value", "deleted")


def checked(proposals: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """UPS8: why a proposal (id, parent, child, name, price, is_add, was_price) may not stand; null if it may."""
    p = parents.select("parent").distinct().withColumn("has_parent", F.lit(True))
    c = children.select("parent", F.col("name").alias("child")).distinct().withColumn("has_child", F.lit(True))
    n = children.select("parent", "name").distinct().withColumn("has_name", F.lit(True))
    rows = proposals.join(p, "parent", "left").join(c, ["parent", "child"], "left").join(n, ["parent", "name"], "left")
    why = (
        F.when(F.col("has_parent").isNull(), "no such parent").when(~F.col("is_add") & F.col("has_child").isNull(), "no such child")
        .when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name").when(F.col("price").isNotNull() & ~((F.col("price") >= 0) & (F.col("price") < 1000)), "price out of range")
        .when(F.col("is_add") & F.col("has_name").isNotNull(), "already there").when(~F.col("is_add") & F.col("price").eqNullSafe(F.col("was_price")) & (F.col("name") == F.col("child")), "changes nothing")
    )
    return rows.select("id", why.alias("reason"))


def digest(entries: DataFrame, *columns: str, by: list[str] | None = None) -> DataFrame:
    """HSH2, HSH3: (n, digest), for each group of ``by`` if given: an order-free digest of canonical rows. Each row's sha-256 is cut into
    four numbers that are summed, so no list of rows is gathered, and the sums are hashed."""
    by = by or []
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    sums = [F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(4)]
    told = F.substring(F.sha2(F.concat_ws("-", "n", *(F.col(f"s{k}").cast("string") for k in range(4))), 256), 1, 32)
    return entries.groupBy(*by).agg(F.count("*").alias("n"), *sums).select(*by, "n", told.alias("digest"))
