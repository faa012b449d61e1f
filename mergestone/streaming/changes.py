"""Stream forms: change detection with keyed state, idempotent arrival, and runs to completion."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write: in spark.checkpoint.dir. Where that is unset, a local one on a single machine,
    as in tests; on a cluster, whose executors would not see it, an error."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Keys of a stream share the state of their bucket, so a task makes a few calls for each bucket, not for each key. The number stays, since
#: checkpoints hold it; a bucket's rows and state grow with the stream.
BUCKETS = 512


def bucket_of(key: str) -> Column:
    """The bucket of a key; a null key has one of its own."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("int").alias("bucket")


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["url", "fetched_at", "fetch_id"], ignore_index=True)
    known = {url: (n, last) for url, n, last in zip(*state.get)} if state.exists else {}
    first = ~rows["url"].duplicated()
    code = pd.Series(pd.factorize(rows["hash"])[0])  # nulls are equal
    # of each url the first fetch here differs from what is held, the others from the one before
    told = {url: known[url] for url in rows["url"][first].tolist() if url in known}
    begins = [url not in told or told[url][1] != now for url, now in zip(rows["url"][first].tolist(), rows["hash"][first].where(rows["hash"][first].notna(), None).tolist())]
    new = code != code.shift()
    new[first] = begins
    number = new.astype("int64").groupby(rows["url"]).cumsum() + rows["url"].map({url: n for url, (n, _) in told.items()}).fillna(0).astype("int64")
    newest = ~rows["url"].duplicated(keep="last")
    known |= {url: (n, None if pd.isna(h) else h) for url, n, h in zip(rows["url"][newest].tolist(), number[newest].tolist(), rows["hash"][newest].tolist())}
    state.update((list(known), [n for n, _ in known.values()], [last for _, last in known.values()]))
    out = rows[new]
    yield pd.DataFrame({"url": None if key[0] == -1 else out["url"], "version": number[new], "fetch_id": out["fetch_id"], "hash": out["hash"]}, index=out.index)


def changed_versions(fetches: DataFrame) -> DataFrame:
    """STM1: of a stream (url, fetched_at, fetch_id, hash) the fetches that begin a new version. The state of a bucket of urls is their last
    hashes and version numbers. Inside a micro-batch a url's fetches are taken in order of time; across micro-batches the order
    of arrival counts, as in the batch form over the same arrivals."""
    rows = fetches.select(bucket_of("url"), F.coalesce("url", F.lit(0)).cast("long").alias("url"), "fetched_at", "fetch_id", "hash")
    return rows.groupBy("bucket").applyInPandasWithState(_changes, "url long, version long, fetch_id long, hash string", "url array<long>, n array<long>, hash array<string>", "append", "NoTimeout")


def once(records: DataFrame, key: str, at: str, late: str = "10 days") -> DataFrame:
    """STM3: of a stream each key once, however often it arrives, within a watermark."""
    return records.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """STM2, STM3: all that is available now, then stop. With a ``folder`` of an earlier run, the checkpoint there makes this run begin
    where that one ended, and the result holds the rows of all runs; without one, the run is the first of a new folder."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, name)
    out, mark = f"{folder}/out", f"{folder}/checkpoint"
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def opened(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def incremental(table: DataFrame, since: DataFrame, at: str) -> DataFrame:
    """STM2 in batch: rows after the watermark of one row (since)."""
    return table.filter(F.col(at) > since.scalar())
