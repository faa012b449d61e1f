"""Streams over the driver's tables, run to their end; their batch twins are in version_plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from mergestone.plans.registry import query, table
from mergestone.plans.version_plans import VERSIONS
from mergestone.streaming import actives as A
from mergestone.streaming import changes as S
from mergestone.streaming import settled as T


@query(f"WITH {VERSIONS} SELECT url, CAST(version AS BIGINT) AS version, version_id AS fetch_id, hash FROM v".replace("min(fetch_id) AS version_id", "arg_min(fetch_id, (fetched_at, fetch_id)) AS version_id"))
def stm1_change_stream(spark, sf_dir):
    o = S.opened(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"), F.col("o_orderkey").alias("fetch_id"), F.col("o_orderstatus").alias("hash"))
    return S.run_to_end(S.changed_versions(o), "changes")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stm3_arrivals_once(spark, sf_dir):
    e = S.opened(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    twice = e.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"), "*").drop("copy")
    return S.run_to_end(S.once(twice, "event_id", "at", "4000 days"), "once").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, max(o_orderkey) AS last FROM orders WHERE CAST(o_orderdate AS DATE) > (SELECT max(CAST(o_orderdate AS DATE)) - 365 FROM orders WHERE o_orderstatus = 'F')""")
def stm2_incremental_pass(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("at", F.to_date("o_orderdate"))
    since = o.filter("o_orderstatus = 'F'").agg(F.date_sub(F.max("at"), 365).alias("since"))
    return S.incremental(o, since, "at").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS run, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1""")
def stm2_resumed_passes(spark, sf_dir):
    """STM2, STM3: three runs over one folder of arrivals and one checkpoint. The second reads only what came since the first, and
    the third, for which nothing came, adds no rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    arrivals, folder = S.shared_folder(spark, "arrivals"), S.shared_folder(spark, "passes")
    done = None
    for run, came in ((1, "o_orderstatus = 'F'"), (2, "o_orderstatus <> 'F'"), (3, None)):
        if came:
            o.filter(came).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(o.schema).parquet(arrivals).select(F.lit(run).alias("run"), "o_orderkey")
        done = S.run_to_end(stream, "passes", folder=folder)
    return done.groupBy("run").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


#: Orders as fetches that arrive by key, so not by time, in four files; the last holds a sentinel that moves the watermark past all others.
SENTINEL = -1


def shuffled_arrivals(spark, sf_dir, files: int = 4) -> str:
    """A folder of files whose rows are in no order of time, and at last a file with one fetch far in the future."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"), F.col("o_orderkey").alias("fetch_id"), F.col("o_orderstatus").alias("hash"))
    folder = S.shared_folder(spark, "fetches")
    for k in range(files):
        o.filter(F.pmod(F.xxhash64("fetch_id"), F.lit(files)) == k).repartition(1).write.mode("append").parquet(folder)
    last = spark.createDataFrame([(SENTINEL, SENTINEL, "")], "url long, fetch_id long, hash string").select("url", F.lit("2200-01-01").cast("timestamp").alias("fetched_at"), "fetch_id", "hash")
    last.coalesce(1).write.mode("append").parquet(folder)
    return folder


@query(f"WITH {VERSIONS} SELECT url, CAST(version AS BIGINT) AS version, version_id AS fetch_id, hash FROM v".replace("min(fetch_id) AS version_id", "arg_min(fetch_id, (fetched_at, fetch_id)) AS version_id").replace("CAST(o_orderdate AS DATE) AS fetched_at", "o_orderdate AS fetched_at"))
def stm1_settled_versions(spark, sf_dir):
    """STM1: the batch form's versions from arrivals in no order of time, by keyed state, timers and a watermark."""
    folder = shuffled_arrivals(spark, sf_dir)
    fetches = spark.readStream.schema("url long, fetched_at timestamp, fetch_id long, hash string").option("maxFilesPerTrigger", 1).parquet(folder)
    out = S.run_to_end(T.settled_versions(fetches, "9000 days"), "settled")
    return out.filter("not late").select("url", "version", "fetch_id", "hash")


@query("""SELECT o_custkey AS url, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS hash, max(o_orderdate)::DATE AS seen, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS fetch_id FROM orders GROUP BY 1""")
def stm2_batch_ledger(spark, sf_dir):
    """STM2, STM3: the newest order of each customer from numbered batches, of which one is delivered again and one fails half way first."""
    schema = "url long, seen date, fetch_id long, hash string"
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.to_date("o_orderdate").alias("seen"), F.col("o_orderkey").alias("fetch_id"), F.col("o_orderstatus").alias("hash"), F.col("o_orderdate").alias("at"))
    ledger = T.Ledger(spark, S.shared_folder(spark, "ledger"), f"{schema}, at timestamp", "url", ["at", "fetch_id"])
    parts = [o.filter(F.pmod(F.xxhash64("fetch_id"), F.lit(3)) == k) for k in range(3)]

    def fails():
        raise RuntimeError("lost")

    ledger.take(parts[0], 0)
    try:
        ledger.take(parts[1], 1, between=fails)
    except RuntimeError:
        pass
    for batch, rows in ((1, parts[1]), (0, parts[0]), (2, parts[2]), (1, parts[1])):
        ledger.take(rows, batch)
    return ledger.table().select("url", "hash", "seen", "fetch_id")


def late_arrivals(spark, sf_dir, files: int = 4) -> str:
    """A folder of events in files by time of arrival, which is up to an hour after the event, and at last a file with one event far in the
    future, which moves the watermark past all sessions and days."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_id")
    e = e.withColumn("arrived", F.unix_timestamp("at") + F.pmod(F.xxhash64("event_id"), F.lit(3600)))
    span = e.agg(F.min("arrived").alias("a"), (F.max("arrived") + 1).alias("z")).first()
    folder, width = S.shared_folder(spark, "arrivals"), ((span.z or 1) - (span.a or 0)) / files
    for k in range(files):
        part = F.least(F.floor((F.col("arrived") - (span.a or 0)) / width), F.lit(files - 1)) == k
        e.filter(part).select("user_id", "at").write.mode("append").parquet(folder)
    last = spark.createDataFrame([(SENTINEL,)], "user_id long").withColumn("at", F.lit("2200-01-01").cast("timestamp"))
    last.select(F.col("user_id").cast(dict(e.dtypes)["user_id"]), "at").coalesce(1).write.mode("append").parquet(folder)
    return folder


def arriving(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS began, epoch_us(max(ts)) - epoch_us(min(ts)) AS lasted, count(*) AS events FROM n GROUP BY user_id, k""")
def stm5_session_stream(spark, sf_dir):
    """STM5: all sessions, from events that arrive out of order, each once its end is behind the watermark."""
    out = S.run_to_end(A.sessions(arriving(spark, late_arrivals(spark, sf_dir)), "user_id", "at", late="61 minutes"), "sessions")
    began, ends = F.unix_micros("start"), F.unix_micros("end") - 5 * 60 * 1_000_000
    return out.filter(F.col("user_id") != SENTINEL).select("user_id", began.alias("began"), (ends - began).alias("lasted"), "events")


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events), w AS (SELECT day + CAST(i AS INT) AS until, user_id FROM d, generate_series(0, 6) t(i)), m AS (SELECT day + CAST(i AS INT) AS until, user_id FROM d, generate_series(0, 27) t(i))
SELECT until, 7 AS days, count(DISTINCT user_id) AS actives, true AS within FROM w GROUP BY 1 UNION ALL SELECT until, 28, count(DISTINCT user_id), true FROM m GROUP BY 1""")
def stm6_actives_by_sketches(spark, sf_dir):
    """STM6: users active in each week and each four weeks, from one stream of daily sketches, beside the exact numbers."""
    sketches = S.run_to_end(A.daily_sketches(arriving(spark, late_arrivals(spark, sf_dir)), "user_id", "at", late="61 minutes"), "sketches").filter("day < DATE'2200-01-01'")
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id").distinct()
    out = None
    for n in (7, 28):
        spans = days.select(F.explode(F.sequence("day", F.date_add("day", n - 1))).alias("until"), "user_id")
        exact = spans.groupBy("until").agg(F.count_distinct("user_id").alias("exact"))
        both = exact.join(A.actives(sketches, n), "until", "full").select("until", F.lit(n).alias("days"), F.col("exact").alias("actives"), A.within(F.col("actives"), F.col("exact")).alias("within"))
        out = both if out is None else out.unionByName(both)
    return out
