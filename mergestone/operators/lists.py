"""Filtered lists, search, facets, nested snapshots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def optional_filter(df: DataFrame, **tests) -> DataFrame:
    """FIL1: each (value, column test) adds a condition only if the value is truthy; a test with ``bound=True`` in its value
    tuple counts unless it is None (FIL2)."""
    for value, test, bound in tests.values():
        if value is not None if bound else value:
            df = df.filter(test)
    return df


def contains(column: str, q: str | None) -> Column:
    """FIL3: case-insensitive, with % and _ in ``q`` as wildcards."""
    return F.col(column).ilike(f"%{q}%")


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """SRT1, AGG1: one page of a sorted list, every row with the count of the whole list from a scalar subquery. A page of 1 to 200."""
    size = min(200, max(1, size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", df.agg(F.count("*").alias("n")).scalar())


def top_each(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """SRT2, SRT5: the first n rows of each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= n)


def current_by_dates(df: DataFrame, as_of: str) -> DataFrame:
    """FIL7: the row that runs on a day (latest start), else the soonest to come, else the newest year; rows (id, year, start, end)."""
    d = F.to_date(F.lit(as_of))
    branch = F.when((F.col("start") <= d) & (F.col("end") >= d), 0).when(F.col("start") > d, 1).otherwise(2)
    key = F.when(branch == 0, -F.unix_date("start")).when(branch == 1, F.unix_date("start")).otherwise(-F.col("year"))
    return df.withColumn("branch", branch).groupBy().agg(F.min(F.struct("branch", key.alias("k"), "id")).alias("m")).select("m.id", "m.branch")


def status_on(start: Column, end: Column, as_of: Column, stored: Column) -> Column:
    """DAT1: bounds count as running; without both dates, what is stored."""
    return F.when(start.isNull() | end.isNull(), stored).when(as_of < start, "upcoming").when(as_of > end, "ended").otherwise("running")


def visible_parents(parents: DataFrame, children: DataFrame, text: str, facets: bool) -> DataFrame:
    """FIL9: a parent (parent) shows if a child (parent, match) matches, or by its own name if no other facet is set; then all its children show."""
    c = children.groupBy("parent").agg(F.count_if("match").alias("n_match"), F.count("*").alias("n_all"))
    own = F.lit(not facets) & F.lower("parent").contains(text.lower())
    out = parents.join(c, "parent", "left").withColumn("by_name", own)
    return out.select("parent", F.when(F.col("by_name"), F.coalesce("n_all", F.lit(0))).otherwise(F.coalesce("n_match", F.lit(0))).alias("n_shown"), (F.col("by_name") | (F.coalesce("n_match", F.lit(0)) > 0)).alias("shown"))


def nested(parents: DataFrame, children: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """JOI3, SNK1, PUB1: parents with their children as an ordered array, empty for none."""
    kids = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    return parents.join(kids, key, "left").withColumn("items", F.when(F.col("items").isNull(), F.expr("filter(array(cast(null as struct<" + ",".join(f"{f}:{dict(children.dtypes)[f]}" for f in fields) + ">)), x -> false)")).otherwise(F.col("items")))


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """SNK2: keys in order, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """MAT3: metres."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


EARTH = 6371000


def nearest(points: DataFrame, places: DataFrame) -> DataFrame:
    """SRT6: ``points`` (id, lat, lon) with the place of ``places`` (place, lat2, lon2) nearest in whole metres, lower places first in
    ties; null for points without a position, or if there are no places. Places without a position are left out.

    Positions are dealt to cubes around their unit vectors, and a position meets the places of the 27 cubes at its own only.
    It is settled once it has a place nearer than the edge of a cube, since none outside can be nearer; otherwise edges are
    doubled, up to cubes that hold the whole sphere. Equal positions are one row."""
    spots = places.dropna(subset=["lat2", "lon2"]).groupBy("lat2", "lon2").agg(F.min("place").alias("place"))
    asks = points.select("lat", "lon").dropna().distinct().withColumn("best", F.lit(None).cast(f"struct<d: double, place: {dict(places.dtypes)['place']}>")).withColumn("settled", F.lit(False))
    n = spots.count()

    def cube(lat: Column, lon: Column, edge: float) -> list[Column]:
        a, o = F.radians(lat), F.radians(lon)
        return [F.floor(x / edge).cast("int") for x in (F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a))]

    for k in range(math.ceil(math.log2(math.sqrt(n + 1))), -1, -1):
        edge = 2 / 2**k
        reach = 2 * EARTH * math.asin(min(1, edge / 2))
        near = F.array([F.lit(i) for i in (-1, 0, 1)])
        # settled positions stay alone, and apart from each other
        apart = F.lit(-(10**9)) - F.pmod(F.xxhash64("lat", "lon"), F.lit(10**6)).cast("int")
        x, y, z = cube(F.col("lat"), F.col("lon"), edge)
        met = F.flatten(F.flatten(F.transform(near, lambda i: F.transform(near, lambda j: F.transform(near, lambda m: F.struct((x + i).alias("x"), (y + j).alias("y"), (z + m).alias("z")))))))
        alone = F.array(F.struct(apart.alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z")))
        dealt = asks.select("lat", "lon", "best", "settled", F.explode(F.when(F.col("settled"), alone).otherwise(met)).alias("c")).select("lat", "lon", "best", "settled", "c.*")
        cells = spots.select("lat2", "lon2", "place", *(v.alias(c) for v, c in zip(cube(F.col("lat2"), F.col("lon2"), edge), "xyz")))
        d = F.round(haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 0)
        found = dealt.join(cells, ["x", "y", "z"], "left").withColumn("found", F.when(F.col("place").isNotNull(), F.struct(d.alias("d"), "place")))
        asks = found.groupBy("lat", "lon").agg(F.min(F.least("best", "found")).alias("best"))
        asks = asks.withColumn("settled", F.coalesce(F.col("best.d") + 1 < reach, F.lit(False)))
    return points.join(asks.select("lat", "lon", F.col("best.place").alias("nearest")), ["lat", "lon"], "left").select("id", "nearest")


def shortened(labels: Column, n: int = 8, total: Column | None = None) -> Column:
    """SRT8: the first n labels and how many more there are; of ``total``, if not all labels were gathered."""
    more = (F.size(labels) if total is None else total) - n
    return F.concat(F.array_join(F.slice(labels, 1, n), ", "), F.when(more > 0, F.concat(F.lit(" and "), more, F.lit(" more"))).otherwise(""))
