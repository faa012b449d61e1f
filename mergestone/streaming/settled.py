"""Keyed state by event time: versions of pages from fetches that arrive late and out of order, and batches that may be repeated."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mergestone.streaming.changes import bucket_of

VERSIONS = "url long, version long, fetch_id long, hash string, late boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Versions(StatefulProcessor):
    """Of a bucket of urls: ``last``, the hashes, numbers and times of their newest versions, and ``waiting``, fetches that the watermark has
    not passed, a list for each Arrow batch that came.

    A fetch waits until a timer says that the watermark has passed its time; by then no earlier one can come any more, so waiting
    fetches are settled in order of time, whatever order they arrived in. The timer is set for the first of those that wait. A fetch that comes
    after the watermark has passed its time is late: it changes nothing and is marked. Where ``forget`` is given, a url that had no fetch for
    more than so long in event time is forgotten, and the next one is its first version again."""

    def __init__(self, forget: int | None):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "url array<long>, hash array<string>, n array<long>, at array<long>")
        self.waiting = handle.getListState("waiting", "url array<long>, at array<long>, fetch_id array<long>, hash array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for part in rows:  # one Arrow batch at a time
            late = part["at"] < passed
            held = part[~late]
            if len(held):
                self.waiting.appendValue(tuple([None if pd.isna(x) else x for x in held[c].tolist()] for c in ("url", "at", "fetch_id", "hash")))
                self.handle.registerTimer(int(held["at"].min()))
            if late.any():
                yield pd.DataFrame({"url": part.loc[late, "url"], "version": None, "fetch_id": part.loc[late, "fetch_id"], "hash": part.loc[late, "hash"], "late": True})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, out = timerValues.getCurrentWatermarkInMs(), []
        held = [r for lists in self.waiting.get() for r in zip(*lists)] if self.waiting.exists() else []
        ready = sorted((r for r in held if r[1] <= passed), key=lambda r: r[:3])
        left = [r for r in held if r[1] > passed]
        known = {url: (now, n, at) for url, now, n, at in zip(*self.last.get())} if self.last.exists() else {}
        for url, at, fetch_id, now in ready:
            last, n, newest = known.get(url, (None, 0, None))
            if self.forget is not None and newest is not None and at > newest + self.forget:
                last, n = None, 0
            if n == 0 or now != last:
                n, last = n + 1, now
                out.append((url, n, fetch_id, now, False))
            known[url] = (last, n, at)
        if self.forget is not None:  # what waits of the others came later still, and begins anew
            known = {url: k for url, k in known.items() if k[2] + self.forget >= passed}
        if known:
            self.last.update((list(known), *(list(c) for c in zip(*known.values()))))
        else:
            self.last.clear()
        if ready:
            self.waiting.put([tuple(list(c) for c in zip(*left))]) if left else self.waiting.clear()
        if left:
            self.handle.registerTimer(min(r[1] for r in left))
        if self.forget is not None and known:
            self.handle.registerTimer(min(k[2] for k in known.values()) + self.forget + 1)
        yield pd.DataFrame(out, columns=["url", "version", "fetch_id", "hash", "late"])

    def close(self) -> None:
        pass


def settled_versions(fetches: DataFrame, delay: str, forget_days: int | None = None) -> DataFrame:
    """STM1: of a stream (url, fetched_at, fetch_id, hash) the fetches that begin a version, once the watermark, ``delay`` behind the newest
    fetch, has passed them: the rows of WIN2 in whatever order fetches arrive. Late ones come out with ``late`` set and no version, for a
    table of their own. Fetches with a null url, time or id have no place in time and are left out."""
    spark = fetches.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the store that keyed state with timers needs
    told = fetches.filter("url is not null and fetched_at is not null and fetch_id is not null").withWatermark("fetched_at", delay)
    # a plain number, so that late rows reach the state instead of being dropped before it
    rows = told.select(bucket_of("url"), "url", F.unix_millis("fetched_at").alias("at"), "fetch_id", "hash")
    forget = None if forget_days is None else forget_days * 86_400_000
    return rows.groupBy("bucket").transformWithStateInPandas(Versions(forget), VERSIONS, "append", "EventTime")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


class Ledger:
    """STM2, STM3: a keyed table in a folder, built from numbered batches, each of which counts once however often it is delivered.

    A batch's newest row of each key is one part of the folder, named after the batch, which is overwritten if the batch comes again; its
    number then goes into the ledger, and a number in the ledger is not taken again. So a failure at any point, before or after
    either write, leaves nothing that a repeated batch would add twice. The table is the newest row of each key over all parts that
    the ledger names."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, order: list[str]):
        self.spark, self.folder, self.schema, self.key, self.order = spark, folder.rstrip("/"), schema, key, order

    def _newest(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c != self.key]
        best = F.max_by(F.struct(*columns), F.struct(*self.order)).alias("r")
        return rows.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(best).select(self.key, *(F.col(f"r.{c}").alias(c) for c in columns))

    def batches(self) -> DataFrame:
        path = f"{self.folder}/ledger"
        return self.spark.read.schema("batch long, n long").parquet(path) if _exists(self.spark, path) else self.spark.createDataFrame([], "batch long, n long")

    def take(self, rows: DataFrame, batch: int, between: Callable[[], None] | None = None) -> bool:
        """Whether this batch was taken now. ``between`` runs after the part is written and before the ledger is, as for a test of failures."""
        if not self.batches().filter(F.col("batch") == batch).isEmpty():
            return False
        part = f"{self.folder}/parts/batch={batch}"
        self._newest(rows).write.mode("overwrite").parquet(part)
        if between is not None:
            between()
        n = self.spark.read.schema(self.schema).parquet(part).count()
        self.spark.createDataFrame([(batch, n)], "batch long, n long").coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")
        return True

    def table(self) -> DataFrame:
        if not _exists(self.spark, f"{self.folder}/ledger"):
            return self.spark.createDataFrame([], self.schema)
        parts = self.spark.read.schema(f"{self.schema}, batch long").parquet(f"{self.folder}/parts")
        return self._newest(parts.join(F.broadcast(self.batches().select("batch").distinct()), "batch", "left_semi").drop("batch"))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Take all that the stream has now, in its batches."""
        stream.writeStream.foreachBatch(lambda rows, batch: self.take(rows, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
