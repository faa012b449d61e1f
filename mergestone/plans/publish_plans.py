"""Publishing over brands and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from mergestone.operators import elements as E
from mergestone.operators import publish as P
from mergestone.operators import resolution as R
from mergestone.operators import snapshots as S
from mergestone.operators.photos import attributed
from mergestone.plans.extract_plans import TITLE
from mergestone.plans.registry import query, table
from mergestone.plans.resolution_plans import LCS, entities, records


@query("SELECT p_partkey, p_brand FROM part WHERE p_size > 5 AND p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING max(p_size) % 2 = 0)")
def fil5_live_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    parents = p.groupBy("p_brand").agg((F.max("p_size") % 2 == 0).alias("is_active"))
    return P.live_rows(parents, p.withColumn("is_active", F.col("p_size") > 5), "p_brand").select("p_partkey", "p_brand")


@query("SELECT * FROM part")
def src1_table_scan(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("""WITH h AS (SELECT p_partkey AS item, p_type AS code, 'dietary' AS kind FROM part UNION ALL SELECT p_partkey, p_brand, 'flavor' FROM part), n AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 4 > 0 THEN 'sweet' END AS code FROM part WHERE p_partkey % 2 = 0)
SELECT * FROM h WHERE kind <> 'flavor' OR item NOT IN (SELECT item FROM n) UNION ALL SELECT item, code, 'flavor' FROM n WHERE code IS NOT NULL""")
def fus8_tag_sync(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    held = p.select(k.alias("item"), F.col("p_type").alias("code"), F.lit("dietary").alias("kind")).unionByName(p.select(k.alias("item"), F.col("p_brand").alias("code"), F.lit("flavor").alias("kind")))
    return P.synced_tags(held, p.filter("p_partkey % 2 = 0").select(k.alias("item"), F.when(k % 4 > 0, "sweet").alias("code")), "flavor")


@query(f"""WITH RECURSIVE {LCS}, r AS (SELECT p_partkey AS record, p_brand AS block, p_name, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS k FROM part), e AS (SELECT p_partkey AS entity, p_brand AS block, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS k, p_size > 20 AS live FROM part WHERE p_partkey % 5 = 0),
m AS (SELECT record, entity, score, row_number() OVER (PARTITION BY record ORDER BY score DESC, live DESC, entity) AS j FROM r JOIN e USING (block) JOIN s ON s.a = r.k AND s.b = e.k),
l AS (SELECT r.record, CASE WHEN score >= 90 THEN 'e' || entity ELSE r.block || '/' || r.p_name END AS entity, coalesce(score, 0) < 70 AS created FROM r LEFT JOIN m ON m.record = r.record AND j = 1 WHERE coalesce(score, 0) >= 90 OR coalesce(score, 0) < 70)
SELECT created, count(*) AS records, count(DISTINCT entity) AS entities FROM l GROUP BY 1""")
def fus9_applied_matches(spark, sf_dir):
    """FUS9, ER8: how many records link to how many entities, old and new."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    payloads = p.select(k.alias("record"), (k % 8).alias("source"), (k % 8).cast("int").alias("rank"), F.col("p_size").alias("observed_at"), F.col("p_name").alias("name"), F.lit("food").alias("category"), F.array(F.lit("vegan")).alias("tags"))
    links, made = P.applied_matches(R.matched(records(spark, sf_dir), entities(spark, sf_dir)), payloads)
    return links.join(made, "entity").groupBy("created").agg(F.count("*").alias("records"), F.count_distinct("entity").alias("entities"))


@query("""WITH p AS (SELECT p_partkey AS position, trim(p_brand) AS name, p_size % 3 <> 0 AS is_active, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part), c AS (SELECT p_brand AS name, string_agg(p_name, ',' ORDER BY p_name) AS items FROM part WHERE p_size > 25 GROUP BY 1)
SELECT position, name, coalesce(items, '') AS items FROM p LEFT JOIN c USING (name) WHERE k = 1 AND is_active""")
def pub2_file_snapshot(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    parents = p.select(F.col("p_partkey").alias("position"), F.concat(F.lit(" "), "p_brand").alias("name"), (F.col("p_size") % 3 != 0).alias("is_active"))
    kids = p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("parent"), (F.col("p_size") > 25).alias("is_active"))
    return P.file_snapshot(parents, kids).withColumn("items", F.array_join("items", ","))


@query(f"SELECT page_id, {TITLE} AS parent, trim(regexp_extract('Pie of ' || {TITLE}, '^([^:]*)', 1)) AS head FROM pages UNION ALL SELECT page_id, 'Holiday Kitchen', 'Cake' FROM pages")
def ext8_guide_photos(spark, sf_dir):
    """EXT8 in whole pages: an image before the headline, which ends in Menu, and more behind the page's end."""
    html = F.regexp_replace("html", F.lit("<h1>([^<]*)</h1>"), F.lit('<img src="/a" alt="Pie of $1: with cream"><img src="/z"><h1>$1 Menu</h1>'))
    html = F.concat(html, F.lit('<img src="/b" alt="Cake"><h4>NEW! Holiday Kitchen Menu</h4><h3>For Kids</h3><img src="/c" alt="Toy"><h3>Last Menu</h3>'))
    return E.guide_photos(E.tokenised(table(spark, sf_dir, "pages").select("page_id", html.alias("html")))).select("page_id", "parent", "head")


@query("SELECT p_partkey AS record, b.entity AS parent FROM part JOIN (SELECT p_brand, min(p_partkey) AS entity FROM part GROUP BY 1) b USING (p_brand) WHERE p_size % 2 = 0")
def er3_parent_resolution(spark, sf_dir):
    """ER3: a child's parent name is matched over the parents of its season, and only sure matches count."""
    p = table(spark, sf_dir, "part")
    parents = p.groupBy(F.col("p_brand").alias("ekey")).agg(F.min("p_partkey").alias("entity")).select("entity", F.lit("2026").alias("block"), "ekey", F.lit(True).alias("is_active"))
    kids = p.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("record"), F.lit("2026").alias("block"), F.col("p_brand").alias("key"))
    return R.matched(kids, parents, least=90).filter("outcome = 'auto_merge'").select("record", F.col("entity").alias("parent"))


@query("""WITH p AS (SELECT p_brand, max(p_partkey) AS stamp FROM part WHERE p_size > 5 GROUP BY 1) SELECT (SELECT count(*) FROM p) AS parents, count(*) AS items, max(p_partkey) AS data_updated_at FROM part WHERE p_size > 5""")
def pub1_snapshot(spark, sf_dir):
    """PUB1, FIL5, JOI3, AGG6: parents with nested live children, and what the snapshot says of itself."""
    from mergestone.operators.lists import nested

    live = table(spark, sf_dir, "part").filter("p_size > 5").withColumnRenamed("p_brand", "parent")
    n = nested(live.select("parent").distinct(), live, "parent", ["p_partkey", "p_name"])
    return n.agg(F.count("*").alias("parents"), F.sum(F.size("items")).alias("items"), F.max(F.array_max(F.transform("items", lambda x: x["p_partkey"]))).alias("data_updated_at"))


#: Children a piece of the snapshot queries, few enough that parents of the small tables have several pieces.
PER = 100


def listed(name, rows, segment, first=False, last=False):
    """The pieces of one list in SQL: ``rows`` is a query of (key, ord, json)."""
    opens, closes = ("{" if first else ",") + f'"{name}":[', "]" + ("}" if last else "")
    return f"""SELECT key, {segment} AS segment, coalesce(piece, 0) AS piece, CASE WHEN coalesce(piece, 0) = 0 THEN '{opens}' ELSE ',' END || coalesce(text, '') || CASE WHEN coalesce(piece, 0) = coalesce(max(piece) OVER (PARTITION BY key), 0) THEN '{closes}' ELSE '' END AS text
    FROM parents LEFT JOIN (SELECT key, piece, string_agg(json, ',' ORDER BY ord) AS text FROM (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY ord) - 1) // {PER} AS piece FROM ({rows})) GROUP BY ALL) USING (key)"""


DOCUMENT = f"""WITH parents AS (SELECT r_regionkey AS key, r_name FROM region), c AS (SELECT customer.*, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey), o AS (SELECT o.*, n_regionkey FROM orders o JOIN c ON c_custkey = o_custkey),
f AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS ref FROM orders GROUP BY ALL),
i AS (SELECT c_custkey, c_name, c_nationkey, n_regionkey, ref FROM c LEFT JOIN f ON o_custkey = c_custkey AND o_orderstatus = CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END WHERE c_acctbal > 0),
p AS ({listed("booths", "SELECT n_regionkey AS key, s_suppkey AS ord, '{\"booth\":' || s_suppkey || ',\"name\":\"' || s_name || '\"}' AS json FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0", 0, first=True)}
UNION ALL {listed("events", "SELECT n_regionkey AS key, o_orderkey AS ord, '{\"id\":' || o_orderkey || ',\"starts\":\"' || CAST(o_orderdate AS DATE) || '\"}' AS json FROM o WHERE o_orderpriority = '1-URGENT'", 1)}
UNION ALL SELECT key, 2, 0, ',"festival":"' || r_name || '"' FROM parents
UNION ALL {listed("items", "SELECT n_regionkey AS key, c_custkey AS ord, '{\"booth\":' || c_nationkey || ',\"credit\":' || CASE WHEN ref IS NULL THEN 'null' WHEN ref % 3 = 0 THEN '\"Example News\"' ELSE '\"photos.example.org\"' END || ',\"item\":' || c_custkey || ',\"name\":\"' || c_name || '\"}' AS json FROM i", 3)}
UNION ALL {listed("seminars", "SELECT n_regionkey AS key, o_orderkey AS ord, '{\"id\":' || o_orderkey || ',\"starts\":\"' || CAST(o_orderdate AS DATE) || '\"}' AS json FROM o WHERE o_orderpriority = '5-LOW'", 4, last=True)})
SELECT key, segment, CAST(piece AS BIGINT) AS piece, length(text) AS n, sha256(text) AS digest FROM p"""


def festival(spark, sf_dir):
    """Regions as festivals: suppliers as booths, customers as items with the credit of their photo, urgent orders as events, low ones as
    seminars; live are those with a balance above zero."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("key"))
    parents = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("festival"))
    booths = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("key", F.col("s_suppkey").alias("booth"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders")
    dated = orders.join(c.select(F.col("c_custkey").alias("o_custkey"), "key"), "o_custkey").select("key", "o_orderpriority", F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("starts"))
    live = c.filter("c_acctbal > 0")
    served = live.select(F.col("c_custkey").alias("item"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("value"))
    shown = orders.select(F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("ref"))
    pages = orders.select(F.col("o_orderkey").alias("ref"), F.when(F.col("o_orderkey") % 3 == 0, "https://www.news.example.com/a").otherwise("https://photos.example.org/b").alias("url"))
    credits = spark.createDataFrame([("news.example.com", "Example News")], "host string, credit string")
    credit = attributed(served, shown, pages, credits).select("item", "credit")
    items = live.select("key", F.col("c_custkey").alias("item"), F.col("c_nationkey").alias("booth"), F.col("c_name").alias("name")).join(credit, "item")
    lists = {"booths": booths, "items": items, "events": dated.filter("o_orderpriority = '1-URGENT'").drop("o_orderpriority"), "seminars": dated.filter("o_orderpriority = '5-LOW'").drop("o_orderpriority")}
    return parents, lists


@query(DOCUMENT)
def pub1_snapshot_document(spark, sf_dir):
    """PUB1, FIL5, JOI3, PHO6, SNK1, SNK2: the pieces of each festival's document, byte for byte."""
    parents, lists = festival(spark, sf_dir)
    rows = S.pieces(parents, lists, "key", {"booths": ["booth"], "items": ["item"], "events": ["id"], "seminars": ["id"]}, PER)
    return rows.select("key", "segment", "piece", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


@query()
def pub1_snapshot_etags(spark, sf_dir):
    """PUB1, HSH2: one tag a document, whatever the order of its children."""
    parents, lists = festival(spark, sf_dir)
    return S.etags(parents, lists, "key")


@query(f"""WITH a AS (SELECT p_partkey AS position, p_brand AS key, p_size % 3 <> 0 AS is_active, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part), parents AS (SELECT key, position FROM a WHERE k = 1 AND is_active),
p AS (SELECT key, 0 AS segment, 0 AS piece, '{{"brand":"' || key || '"' AS text FROM parents UNION ALL {listed("items", "SELECT p_brand AS key, (p_name, p_partkey) AS ord, '{\"item\":\"' || p_name || '\"}' AS json FROM part WHERE p_size > 25", 1)} UNION ALL SELECT key, 2, 0, ',"position":' || position || '}}' FROM parents)
SELECT key AS name, segment, CAST(piece AS BIGINT) AS piece, text FROM p""")
def pub2_file_snapshot_pieces(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    parents = p.select(F.col("p_partkey").alias("position"), F.concat(F.lit(" "), "p_brand").alias("name"), (F.col("p_size") % 3 != 0).alias("is_active"))
    kids = p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("parent"), (F.col("p_size") > 25).alias("is_active"))
    return P.file_snapshot_pieces(parents, kids, PER).select("name", "segment", "piece", "text")
