"""Versions, support, guards and metrics: a customer is a page, an order a fetch of it, the order status its hash."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mergestone.operators import lifecycle as L
from mergestone.operators import versions as V
from mergestone.plans.registry import query, table

FETCH = "f AS (SELECT o_custkey AS url, CAST(o_orderdate AS DATE) AS fetched_at, o_orderkey AS fetch_id, o_orderstatus AS hash FROM orders)"
VERSIONS = f"""{FETCH}, c AS (SELECT *, CASE WHEN lag(hash) OVER w IS NOT DISTINCT FROM hash AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS changed FROM f WINDOW w AS (PARTITION BY url ORDER BY fetched_at, fetch_id)),
n AS (SELECT *, sum(changed) OVER (PARTITION BY url ORDER BY fetched_at, fetch_id) AS version FROM c),
r AS (SELECT url, version, min(hash) AS hash, min(fetched_at) AS first_seen, max(fetched_at) AS last_seen_unchanged, min(fetch_id) AS version_id, count(*) AS n_fetches FROM n GROUP BY url, version),
v AS (SELECT *, lead(version_id) OVER (PARTITION BY url ORDER BY version) AS superseded_by FROM r)"""


def fetches(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.to_date("o_orderdate").alias("fetched_at"), F.col("o_orderkey").alias("fetch_id"), F.col("o_orderstatus").alias("hash"))


def live(spark, sf_dir):
    return V.versions(fetches(spark, sf_dir)).filter("is_live")


@query(f"WITH {VERSIONS} SELECT url, CAST(version AS BIGINT) AS version, hash, first_seen, last_seen_unchanged, version_id, n_fetches, superseded_by, superseded_by IS NULL AS is_live FROM v")
def win2_version_chain(spark, sf_dir):
    """WIN2, WIN3, WIN4"""
    return V.versions(fetches(spark, sf_dir))


@query(f"WITH {VERSIONS} SELECT url, hash, version_id FROM v WHERE superseded_by IS NULL")
def win1_live_versions(spark, sf_dir):
    """WIN1, FIL6"""
    return live(spark, sf_dir).select("url", "hash", "version_id")


@query("SELECT coalesce(max(CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'F'), DATE '2026-10-22' - 30) AS since FROM orders")
def win12_watermark(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"), F.to_date("o_orderdate").alias("finished_at"))
    return V.watermark(runs, "2026-10-22")


@query("""WITH e AS (SELECT user_id AS source, event_id AS position, event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY 1 LIMIT 2) AS error FROM events),
g AS (SELECT *, sum(CASE WHEN error THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY position) AS island FROM e), s AS (SELECT source, position, row_number() OVER (PARTITION BY source, island ORDER BY position) AS streak FROM g WHERE error)
SELECT source, min(position) AS stopped_at FROM s WHERE streak = 3 GROUP BY source""")
def stm4_error_stops(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = e.select("event_type").distinct().orderBy("event_type").limit(2).withColumn("error", F.lit(True))
    rows = e.join(F.broadcast(kinds), "event_type", "left").select(F.col("user_id").alias("source"), F.col("event_id").alias("position"), F.coalesce("error", F.lit(False)).alias("error"))
    return V.error_stops(rows)


@query("""WITH n AS (SELECT o_custkey AS page, o_orderstatus AS kind, o_orderkey AS r, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 0),
o AS (SELECT o_custkey AS page, o_orderstatus AS kind, o_orderkey AS r, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 1)
SELECT n.page, n.kind, n.n, n.r AS new_record, o.r AS old_record FROM n LEFT JOIN o USING (page, kind, n)""")
def joi13_positional_pairs(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("record"))
    return V.positional_pairs(r.filter("record % 2 = 1"), r.filter("record % 2 = 0")).select("page", "kind", F.col("n").cast("long").alias("n"), "new_record", "old_record")


SUPPORT = f"""{VERSIONS}, live AS (SELECT version_id FROM v WHERE superseded_by IS NULL),
s AS (SELECT DISTINCT l_partkey AS entity FROM lineitem JOIN live ON version_id = l_orderkey WHERE l_suppkey % {{k}} <> 0),
e AS (SELECT p_partkey AS entity, p_brand AS parent, p_partkey % 40 = 0 AS curated, p_partkey % 9 <> 0 AS is_active FROM part),
w AS (SELECT e.*, curated OR s.entity IS NOT NULL AS wanted FROM e LEFT JOIN s USING (entity)),
g AS (SELECT count(*) FILTER (is_active) > 0 AND (count(*) FILTER (is_active AND NOT wanted) = count(*) FILTER (is_active) OR count(*) FILTER (is_active AND NOT wanted) > 0.6 * count(*) FILTER (is_active)) AS refused FROM w),
j AS (SELECT entity, parent, curated, is_active AS was_active, CASE WHEN refused THEN is_active ELSE wanted END AS is_active, refused FROM w, g)"""
CHANGE = "CASE WHEN was_active AND NOT is_active THEN 'retired' WHEN NOT was_active AND is_active THEN 'reactivated' WHEN is_active THEN 'kept' ELSE 'stays_retired' END"


def judged(spark, sf_dir, k):
    pages = live(spark, sf_dir).select(F.col("version_id").alias("page"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("source"))
    out = table(spark, sf_dir, "supplier").filter(f"s_suppkey % {k} = 0").select(F.col("s_suppkey").alias("source"))
    p = F.col("p_partkey")
    entities = table(spark, sf_dir, "part").select(p.alias("entity"), F.col("p_brand").alias("parent"), (p % 40 == 0).alias("curated"), (p % 9 != 0).alias("is_active"))
    return L.judged(entities, L.supported(links, pages, out))


@query(f"WITH {SUPPORT.format(k=8)} SELECT DISTINCT entity FROM s")
def lif1_support_set(spark, sf_dir):
    """LIF1, JOI4, JOI5"""
    pages = live(spark, sf_dir).select(F.col("version_id").alias("page"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("source"))
    return L.supported(links, pages, table(spark, sf_dir, "supplier").filter("s_suppkey % 8 = 0").select(F.col("s_suppkey").alias("source")))


@query(f"WITH {SUPPORT.format(k=8)} SELECT *, {CHANGE} AS change FROM j")
def lif4_retire_and_reactivate(spark, sf_dir):
    """LIF2, LIF4"""
    return judged(spark, sf_dir, 8)


@query(f"WITH {SUPPORT.format(k=1)} SELECT *, {CHANGE} AS change FROM j")
def lif5_refused_pass(spark, sf_dir):
    return judged(spark, sf_dir, 1)


#: Parents are brands, children parts; support follows from suppliers that are not left out.
TOGETHER = """p AS (SELECT p_brand AS entity, count(*) FILTER (p_size = 1) % 5 = 0 AS curated, min(p_partkey) % 6 <> 5 AS is_active FROM part GROUP BY 1),
c AS (SELECT p_partkey AS entity, p_brand AS parent, p_partkey % 40 = 0 AS curated, p_partkey % 9 <> 0 AS is_active FROM part),
ps AS (SELECT DISTINCT p_brand AS entity FROM part WHERE {parents}), cs AS (SELECT DISTINCT l_partkey AS entity FROM lineitem WHERE {children}),
pw AS (SELECT *, NOT curated AND entity IN (SELECT entity FROM ps) AS wanted FROM p),
cw AS (SELECT c.*, NOT curated AND entity IN (SELECT entity FROM cs) AND parent IN (SELECT entity FROM pw WHERE wanted OR (curated AND is_active)) AS wanted FROM c),
g AS (SELECT (SELECT count(*) FILTER (is_active AND NOT curated) > 0 AND count(*) FILTER (is_active AND NOT curated AND NOT wanted) = count(*) FILTER (is_active AND NOT curated) OR count(*) FILTER (is_active AND NOT curated AND NOT wanted) > 0.6 * count(*) FILTER (is_active AND NOT curated) FROM pw)
OR (SELECT count(*) FILTER (is_active AND NOT curated) > 0 AND count(*) FILTER (is_active AND NOT curated AND NOT wanted) = count(*) FILTER (is_active AND NOT curated) FROM cw) AS refused),
b AS (SELECT 'parent' AS side, CAST(entity AS VARCHAR) AS entity, curated, is_active, wanted FROM pw UNION ALL SELECT 'child', CAST(entity AS VARCHAR), curated, is_active, wanted FROM cw),
d AS (SELECT side, entity, curated, is_active AS was_active, CASE WHEN curated OR refused THEN is_active ELSE wanted END AS is_active, refused FROM b, g)"""


def together(spark, sf_dir, parents, children):
    part = table(spark, sf_dir, "part")
    p = part.groupBy(F.col("p_brand").alias("entity")).agg((F.count_if(F.col("p_size") == 1) % 5 == 0).alias("curated"), (F.min("p_partkey") % 6 != 5).alias("is_active"))
    k = F.col("p_partkey")
    c = part.select(k.alias("entity"), F.col("p_brand").alias("parent"), (k % 40 == 0).alias("curated"), (k % 9 != 0).alias("is_active"))
    out = L.judged_together(p, c, part.filter(parents).select(F.col("p_brand").alias("entity")), table(spark, sf_dir, "lineitem").filter(children).select(F.col("l_partkey").alias("entity")))
    rows = [df.select(F.lit(side).alias("side"), F.col("entity").cast("string").alias("entity"), "curated", "was_active", "is_active", "change", "refused") for side, df in zip(("parent", "child"), out)]
    return rows[0].unionByName(rows[1])


@query(f"WITH {TOGETHER.format(parents='p_brand <> (SELECT max(p_brand) FROM part)', children='l_suppkey % 3 = 0 AND l_linenumber = 1')} SELECT *, {CHANGE} AS change FROM d")
def lif5_one_verdict_passes(spark, sf_dir):
    """LIF2-LIF5: parents and children retired and reactivated together; one brand has no support, and takes its parts along."""
    last = table(spark, sf_dir, "part").agg(F.max("p_brand")).first()[0]
    return together(spark, sf_dir, F.col("p_brand") != last, F.expr("l_suppkey % 3 = 0 and l_linenumber = 1"))


@query(f"WITH {TOGETHER.format(parents='p_size < 0', children='true')} SELECT *, {CHANGE} AS change FROM d")
def lif5_one_verdict_refuses(spark, sf_dir):
    """LIF5: no parent has support, so both halves are refused, though children alone would pass."""
    return together(spark, sf_dir, F.expr("p_size < 0"), F.expr("true"))


@query(f"""WITH {SUPPORT.format(k=8)} SELECT p_size AS child, j.entity AS parent_entity, j.is_active AND p_size % 2 = 0 AS is_active FROM (SELECT DISTINCT p_size, p_partkey FROM part) c JOIN j ON c.p_partkey = j.entity""")
def lif3_children_follow_parents(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.col("p_size").alias("child"), F.col("p_partkey").alias("parent"), (F.col("p_size") % 2 == 0).alias("is_active")).distinct()
    return L.follow_parents(c, judged(spark, sf_dir, 8)).select("child", F.col("parent").alias("parent_entity"), "is_active")


@query(f"WITH {SUPPORT.format(k=8)} SELECT {CHANGE} AS change, count(*) AS n FROM j GROUP BY 1")
def agg8_status_histogram(spark, sf_dir):
    return judged(spark, sf_dir, 8).groupBy("change").agg(F.count("*").alias("n"))


GUARD = """WITH b AS (SELECT p_partkey AS id FROM part), a AS (SELECT p_partkey AS id FROM part WHERE p_partkey % {k} <> 0), d AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 12 = 0),
l AS (SELECT count(*) AS n_lost FROM b WHERE id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM d)), n AS (SELECT count(*) AS n_before FROM b), c AS (SELECT count(*) AS n_after FROM a)
SELECT n_before, n_lost, CAST(greatest(5, floor(n_before * 0.1)) AS BIGINT) AS allowed, n_lost > greatest(5, floor(n_before * 0.1)) OR (n_after = 0 AND n_before > 0) AS refused FROM n, l, c"""


def guard(spark, sf_dir, k):
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return L.loss_guard(b, b.filter(f"id % {k} <> 0"), b.filter("id % 12 = 0"))


@query(GUARD.format(k=24))
def grd2_loss_guard_passes(spark, sf_dir):
    """GRD2, JOI16"""
    return guard(spark, sf_dir, 24)


@query(GUARD.format(k=3))
def grd2_loss_guard_refuses(spark, sf_dir):
    return guard(spark, sf_dir, 3)


@query("""WITH i AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 41 = 0 THEN 'same' ELSE 'id-' || p_partkey END AS public_id, CASE WHEN p_partkey % 30 = 0 THEN 'lost' ELSE p_brand END AS parent FROM part)
SELECT id, 'missing public_id' AS problem FROM i WHERE public_id IS NULL UNION ALL SELECT id, 'duplicate public_id' FROM i WHERE public_id IN (SELECT public_id FROM i GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT id, 'no parent' FROM i WHERE parent NOT IN (SELECT p_brand FROM part)""")
def grd1_inventory_problems(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    items = p.select(k.alias("id"), F.when(k % 50 == 0, None).when(k % 41 == 0, "same").otherwise(F.concat(F.lit("id-"), k)).alias("public_id"), F.when(k % 30 == 0, "lost").otherwise(F.col("p_brand")).alias("parent"))
    return L.inventory_problems(items, p.select(F.col("p_brand").alias("id")).distinct())


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)")
def joi6_not_yet_held(spark, sf_dir):
    """JOI6: customers without a large order that is done."""
    held = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return L.unheld(table(spark, sf_dir, "customer").select("c_custkey"), held, "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber >= 2)")
def joi7_not_yet_linked(spark, sf_dir):
    """JOI7, ER7: records, as orders, that have no link yet."""
    links = table(spark, sf_dir, "lineitem").filter("l_linenumber >= 2").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.unheld(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), links, "o_orderkey")


@query("""WITH h AS (SELECT o_custkey AS url, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders),
x AS (SELECT url, h, CAST('0x' || substr(h, 1, 12) AS HUGEINT) AS a, CAST('0x' || substr(h, 13, 12) AS HUGEINT) AS b, CAST('0x' || substr(h, 25, 12) AS HUGEINT) AS c, CAST('0x' || substr(h, 37, 12) AS HUGEINT) AS d FROM h)
SELECT url, count(*) AS n, substr(sha256(concat_ws('-', count(*), sum(a), sum(b), sum(c), sum(d))), 1, 32) AS digest, CASE WHEN url % 5 = 0 THEN 1 ELSE 2 END AS version FROM x WHERE url % 3 = 0 OR url % 5 = 0 GROUP BY url""")
def ups5_staged_lists(spark, sf_dir):
    """UPS5, HSH3: of each customer's list of orders those that changed or are new. One in three was held with other statuses, one in five
    not at all; the others are held as they are, and are not staged again."""
    from mergestone.operators.overlay import digest

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), "o_orderkey", "o_orderstatus")
    before = o.filter("url % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("url") % 3 == 0, "?").otherwise(F.col("o_orderstatus")))
    lists = lambda df: digest(df, "o_orderkey", "o_orderstatus", by=["url"])
    none = lists(o.limit(0)).select("url", "digest", F.lit(0).cast("long").alias("version"))
    held = L.staged(lists(before), none, "url").select("url", "digest", "version")
    return L.staged(lists(o), held, "url")


@query("""SELECT s_suppkey AS k, s_name AS v FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def src9_insert_or_ignore(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return L.upserted(s, c, "k", update=False)


@query("""SELECT c_custkey AS k, c_name AS v FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)""")
def src9_insert_or_update(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return L.upserted(s, c, "k", update=True)


# ------------------------------------------------------------------------------------------------------------ metrics

MONTHS = """m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) // 8 AS items, count(DISTINCT o_custkey) // 50 AS booths, count(*) FILTER (o_orderstatus = 'F') // 20 AS priced FROM orders GROUP BY 1)"""


def history(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.expr("count(*) div 8").alias("items"), F.expr("count(distinct o_custkey) div 50").alias("booths"), F.expr("count_if(o_orderstatus = 'F') div 20").alias("priced"))


@query(f"""WITH {MONTHS}, l AS (SELECT *, (lead(items) OVER w) = items AND (lead(booths) OVER w) = booths AND (lead(priced) OVER w) = priced AS repeated FROM m WINDOW w AS (ORDER BY month)) SELECT month, items, booths, priced FROM l WHERE repeated IS NOT TRUE""")
def agg9_history_without_repeats(spark, sf_dir):
    w = Window.orderBy("month")  # one row a month
    same = F.lead(F.struct("items", "booths", "priced")).over(w).eqNullSafe(F.struct("items", "booths", "priced"))
    return history(spark, sf_dir).withColumn("same", same).filter("not same").drop("same")


@query(f"""WITH {MONTHS}, u AS (SELECT month, 'items' AS metric, items AS v FROM m UNION ALL SELECT month, 'booths', booths FROM m UNION ALL SELECT month, 'priced', priced FROM m), d AS (SELECT month, metric, v AS current, lag(v) OVER (PARTITION BY metric ORDER BY month) AS previous FROM u)
SELECT month, metric, current, previous, current - previous AS delta, CASE WHEN previous IS NULL OR current = previous THEN 'same' WHEN current > previous THEN 'gain' ELSE 'loss' END AS verdict FROM d""")
def agg10_metric_diff(spark, sf_dir):
    u = history(spark, sf_dir).unpivot("month", ["items", "booths", "priced"], "metric", "current")
    p = F.lag("current").over(Window.partitionBy("metric").orderBy("month"))
    d = u.withColumn("previous", p).withColumn("delta", F.col("current") - F.col("previous"))
    return d.withColumn("verdict", F.when(F.coalesce("delta", F.lit(0)) == 0, "same").when(F.col("delta") > 0, "gain").otherwise("loss"))


@query("""SELECT count(DISTINCT p_brand) AS booths, count(*) AS items, count(*) FILTER (p_retailprice > 1000) AS priced, count(*) FILTER (p_size % 3 = 0) AS with_image, count(*) FILTER (contains(p_name, 'e')) AS tagged,
count(DISTINCT CASE WHEN p_size % 3 = 0 THEN p_brand END) AS booths_with_image, round(count(*) FILTER (p_retailprice > 1000) * 100.0 / nullif(count(*), 0), 1) AS pct_priced, CAST(NULL AS DOUBLE) AS pct_of_none FROM part""")
def agg2_coverage_metrics(spark, sf_dir):
    share = lambda n, d: F.when(d != 0, F.round(n * 100.0 / d, 1)).cast("double")  # noqa: E731  AGG3
    priced = F.count_if(F.col("p_retailprice") > 1000)
    return table(spark, sf_dir, "part").agg(
        F.count_distinct("p_brand").alias("booths"), F.count("*").alias("items"), priced.alias("priced"), F.count_if(F.col("p_size") % 3 == 0).alias("with_image"), F.count_if(F.col("p_name").contains("e")).alias("tagged"),
        F.count_distinct(F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))).alias("booths_with_image"), share(priced, F.count("*")).alias("pct_priced"), share(priced, F.count_if(F.lit(False))).alias("pct_of_none"),
    )


@query("SELECT p_brand AS parent, count(*) AS dishes, count(*) FILTER (p_size % 3 = 0) AS with_photo FROM part GROUP BY 1")
def agg18_coverage_by_parent(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("parent")).agg(F.count("*").alias("dishes"), F.count_if(F.col("p_size") % 3 == 0).alias("with_photo"))


@query("""SELECT o_custkey % 10 AS run, sum(l_linenumber) AS lines, sum(CAST(l_quantity AS BIGINT)) AS units, count(DISTINCT o_orderkey) AS orders, max(CAST(greatest(o_orderdate, l_shipdate) AS DATE)) AS data_updated_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def agg7_run_rollup(spark, sf_dir):
    """AGG6, AGG7, JOI1: counters of a run, and the latest stamp of parents and children."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy((F.col("o_custkey") % 10).alias("run")).agg(F.sum("l_linenumber").alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("units"), F.count_distinct("o_orderkey").alias("orders"), F.max(F.to_date(F.greatest("o_orderdate", "l_shipdate"))).alias("data_updated_at"))


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(DISTINCT user_id) AS devices, count(*) AS events FROM events GROUP BY ALL""")
def agg17_daily_actives(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count_distinct("user_id").alias("devices"), F.count("*").alias("events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
z AS (SELECT user_id, k, count(*) AS events, epoch(max(ts)) - epoch(min(ts)) AS secs FROM n GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(events) AS longest FROM z GROUP BY 1""")
def stm5_sessions(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "5 minutes")).agg(F.count("*").alias("events"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events), w AS (SELECT day + CAST(i AS INT) AS until, user_id FROM d, generate_series(0, 6) t(i)) SELECT until, count(DISTINCT user_id) AS weekly FROM w GROUP BY 1""")
def stm6_weekly_actives(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id").distinct()
    return d.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_add(F.col("day"), i))).alias("until"), "user_id").groupBy("until").agg(F.count_distinct("user_id").alias("weekly"))
