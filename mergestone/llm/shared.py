"""Tables in the folder all executors share, and connected components over link tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a new local one on a single machine, as in tests; on a cluster,
    whose executors would not see it, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing will read again."""
    path = getattr(df, "_written_to", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: A key held by more than one row in so many is hot, and so are no more than that many keys.
HOT = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str, held: str, total: int, least: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each ``key`` and in ``held`` how many rows hold it.

    Rows of a hot key, one that more than ``total`` / :data:`HOT` rows hold, are not dealt by key: the table's rows of hot keys,
    fewer than :data:`HOT`, go to all tasks. All others are joined by key."""
    bound = max(least, total // HOT)
    hot, cold = table.filter(F.col(held) > bound), table.filter(F.col(held) <= bound)
    by_task = rows.join(F.broadcast(hot), key)
    by_key = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return by_task.unionByName(by_key).drop(held)


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Connected components of ``links`` (a, b): one row (node, component) for each node that has a link; component
    is the smallest node that can be reached.

    Alternating large-star and small-star steps (public method for map-reduce systems): each step replaces links by
    links to the smallest neighbour, so a long chain shrinks by about half a step and a star is done at once. Only
    minima are aggregated, never neighbour lists, and the leaves of a large star are not dealt by its centre. Each step's
    table is written to the shared folder.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    total = 2 * edges.count()
    if not total:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        wide = both(edges)
        low = written(wide.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("held")), name)
        large = looked_up(wide, low, "a", "held", total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, name)
        dropped(low)
        low = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("held")), name)
        small = looked_up(large, low, "a", "held", total).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("p"))
        small = small.select(F.col("p.b").alias("a"), F.col("p.m").alias("b")).filter("a <> b").distinct()
        small = written(small, name)
        for table in (low, edges, large):
            dropped(table)
        edges = small
        # done when all that is left are stars: no node has two centres, and no centre has one itself
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("n"), F.lit(0).alias("c")).unionByName(
            edges.select(F.col("b").alias("node"), F.lit(0).alias("n"), F.lit(1).alias("c"))
        )
        if ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("c").alias("c")).filter("n + c > 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )


def at_most(df: DataFrame, column: str, n: int, scale: float = 1.0) -> DataFrame:
    """The rows of the largest values, at most ``n`` of them: all whose value, cut to steps of 1 / ``scale``, is above the
    first step that no longer fits. Only counts by step reach the driver, not the rows of every task, as with a limit."""
    step = F.floor(F.col(column) * scale)
    seen, least = 0, None
    for r in df.groupBy(step.alias("s")).count().orderBy(F.desc("s")).toLocalIterator():
        seen += r[1]
        if seen > n:
            break
        least = r[0]
    return df.filter(step >= least) if least is not None else df.filter("false")
