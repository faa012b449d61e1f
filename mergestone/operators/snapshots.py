"""Nested documents as numbered pieces of text: no row, task or array holds all children of a parent, however many there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergestone.operators.overlay import digest
from mergestone.operators.rounds import kept

#: Children a piece.
PER = 1000


def _json(fields: list[str]) -> Column:
    return F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with their ``place`` (from 0) among those of their key in ``order``. Rows are dealt by ranges of key and order, so that a
    key with many rows is in many tasks; a place is what the ranges before hold of the key and the place inside the own range.
    Rows that are equal in key and order are dealt by a number of their own, and have any order among themselves."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, key, *order, "tie")
    dealt = kept(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(key, "range").agg(F.count("*").alias("n")).select(key, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(key, "range").orderBy(*order, "tie")) - 1
    return dealt.withColumn("inside", inside).join(starts, [key, "range"]).withColumn("place", F.col("start") + F.col("inside")).drop("tie", "range", "start", "inside")


def pieces(parents: DataFrame, lists: dict[str, DataFrame], key: str, orders: dict[str, list[str]], per: int = PER) -> DataFrame:
    """SNK1, JOI3, PUB1, PUB2: (key, segment, piece, text, ends) of one JSON object a row of ``parents``, whose texts in the order of segment
    and piece are the canonical JSON of the parent's columns and of its lists, names in order. A list's frame holds the key, the
    children's columns, and is in the order of ``orders``; a piece has at most ``per`` children, so what a row holds has a bound.
    ``ends`` is how many characters at the end of a piece close a list or the object.

    Parents have distinct keys that are not null. A parent without children has an empty list, children without a parent are
    left out, nulls are written as null, and equal children are all written."""
    names = sorted([c for c in parents.columns if c != key] + list(lists))
    out, scalars, segment = None, [], 0

    def add(frame: DataFrame, text: Column):
        nonlocal out, segment
        text = F.concat(F.lit("{" if segment == 0 else ","), text)
        last = frame.select(key, F.lit(segment).alias("segment"), "piece", F.when(F.col("piece") == 0, text).otherwise(F.concat(F.lit(","), "text")).alias("text"), "closing")
        out, segment = last if out is None else out.unionByName(last), segment + 1

    def add_scalars():
        if scalars:
            body = _json(scalars)
            add(parents.select(key, F.lit(0).cast("long").alias("piece"), F.substring(body, 2, F.length(body) - 2).alias("text"), F.lit("").alias("closing")), F.col("text"))
            scalars.clear()

    for name in names:
        if name not in lists:
            scalars.append(name)
            continue
        add_scalars()
        kids = lists[name]
        rows = numbered(kids.select(key, *orders[name], _json([c for c in kids.columns if c != key]).alias("json")), key, orders[name])
        held = F.array_sort(F.collect_list(F.struct("place", "json")))
        chunks = rows.groupBy(key, F.floor(F.col("place") / per).alias("piece")).agg(F.array_join(F.transform(held, lambda x: x["json"]), ",").alias("text"))
        last = rows.groupBy(key).agg(F.floor(F.max("place") / per).alias("last"))
        frame = parents.select(key).join(last, key, "left").join(chunks, key, "left")
        ends = F.when(F.col("piece") == F.coalesce("last", F.lit(0)), "]").otherwise("")
        frame = frame.withColumn("piece", F.coalesce("piece", F.lit(0).cast("long"))).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("closing", ends)
        add(frame, F.concat(F.lit(f'"{name}":['), "text"))
    add_scalars()
    ends = F.when(F.col("segment") == segment - 1, F.lit("}")).otherwise("")
    # the last segment may have many pieces: the brace stands behind its closing bracket, or behind scalars
    closing = F.when((F.col("closing") == "]") | F.lit(bool(names) and names[-1] not in lists), F.concat("closing", ends)).otherwise("")
    return out.select(key, "segment", "piece", F.concat("text", closing).alias("text"), F.length(closing).alias("ends"))


def etags(parents: DataFrame, lists: dict[str, DataFrame], key: str) -> DataFrame:
    """HSH2: (key, etag) of what ``pieces`` writes, whatever the order of children: each list counts by its number of rows and the digest of
    its rows, which sums combine before the shuffle."""
    out = parents.withColumn("own", _json(parents.columns))
    for name in sorted(lists):
        kids = lists[name]
        out = out.join(digest(kids, *[c for c in kids.columns if c != key], by=[key]).select(key, F.concat_ws("-", "n", "digest").alias(f"digest of {name}")), key, "left")
    parts = [F.coalesce(f"digest of {name}", F.lit("0")) for name in sorted(lists)]
    return out.select(key, F.substring(F.sha2(F.concat_ws("|", "own", *parts), 256), 1, 32).alias("etag"))


def write_snapshot(rows: DataFrame, key: str, folder: str) -> None:
    """Pieces as JSON lines in the order of key, segment and piece; files are dealt by ranges, so a large parent is in several of them, in
    order, and the texts of all files one after another are all documents."""
    rows.repartitionByRange(key, "segment", "piece").sortWithinPartitions(key, "segment", "piece").write.json(folder)


def read_list(rows: DataFrame, key: str, name: str, schema: str) -> DataFrame:
    """PRJ1: the children of one list out of pieces, a row each; ``schema`` is that of a child. Pieces of the list are told by their
    segment, which the piece that opens the list shows."""
    opens = rows.filter((F.col("piece") == 0) & F.col("text").substr(2, len(name) + 4).eqNullSafe(f'"{name}":[')).select(F.min("segment")).scalar()
    start = F.when(F.col("piece") == 0, len(name) + 5).otherwise(1)
    body = F.substring("text", start + 1, F.length("text") - start - F.col("ends"))
    return rows.filter(F.col("segment") == opens).select(key, F.inline(F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<struct<{schema}>>")))
