"""Sources and sinks: rows of the driver's tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from mergestone.operators.snapshots import pieces, read_list, write_snapshot
from mergestone.plans.registry import query, table
from mergestone.sources import files as S
from mergestone.sources.keyed_folders import keyed_folders
from mergestone.streaming.changes import shared_folder


@query("SELECT p_brand AS key, p_partkey, p_name FROM part")
def src4_folder_per_key(spark, sf_dir):
    """SRC4, SNK3"""
    out = shared_folder(spark, "feed")
    S.write_feed(table(spark, sf_dir, "part").select(F.translate("p_brand", "#", "-").alias("brand"), "p_partkey", "p_name"), "brand", out)
    rows = spark.read.schema("p_partkey long, p_name string, brand string").json(f"{out}/feed")
    return rows.select(F.translate("brand", "-", "#").alias("key"), "p_partkey", "p_name")


@query("SELECT p_brand AS key, p_partkey, p_name FROM part WHERE p_brand IN ('Brand#3', 'Brand#11', 'Brand#14')")
def src4_asked_folders(spark, sf_dir):
    """SRC4, SRC1: of one folder a brand, those that are asked for are read."""
    out = shared_folder(spark, "feed")
    S.write_feed(table(spark, sf_dir, "part").select(F.translate("p_brand", "#", "-").alias("brand"), "p_partkey", "p_name"), "brand", out)
    rows = keyed_folders(spark, f"{out}/feed", ".json", "key string, p_partkey long, p_name string", "brand=", ["Brand-3", "Brand-11", "Brand-14"])
    return rows.select(F.translate("key", "-", "#").alias("key"), "p_partkey", "p_name")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def snk3_feed_index(spark, sf_dir):
    return S.write_feed(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", shared_folder(spark, "feed"))


@query("SELECT p_partkey, p_name FROM part UNION ALL SELECT p_partkey, p_name FROM part")
def snk4_manifests(spark, sf_dir):
    out = shared_folder(spark, "manifest")
    S.write_manifest(table(spark, sf_dir, "part").select("p_partkey", "p_name"), out)
    kind = "p_partkey long, p_name string"
    return spark.read.schema(kind).json(f"{out}/manifest-json").unionByName(spark.read.schema(kind).option("header", True).csv(f"{out}/manifest-csv"))


@query("SELECT p_brand AS festival, p_name AS name, p_type AS category, CAST(p_size AS DOUBLE) AS price_usd FROM part")
def src7_changeset_scan(spark, sf_dir):
    """SRC7, PRJ6: keys that are not in the schema are not let in."""
    out = shared_folder(spark, "changeset")
    p = table(spark, sf_dir, "part")
    item = F.array(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_size").alias("price_usd"), F.lit(1).alias("secret")))
    p.select(F.lit(1).alias("version"), F.col("p_brand").alias("festival"), item.alias("menu_items"), F.lit("x").alias("other")).write.json(out)
    return S.changeset(spark, out, lines=True).select("festival", "name", "category", "price_usd")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'doc-' || doc_id ELSE 'photo-' || sha256('a/' || doc_id)[1:32] END || '.png' AS file, strlen(text) AS n FROM documents WHERE text IS NOT NULL""")
def src8_embedded_binaries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    id_ = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doc-"), "doc_id")).otherwise(F.concat(F.lit("a/"), "doc_id"))
    block = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "")
    rows = d.select("doc_id", S.photo_name(id_, F.lit("image/png")).alias("file"), F.try_to_binary(block, F.lit("base64")).alias("bytes"))
    return rows.select("doc_id", "file", F.length("bytes").cast("long").alias("n"))


@query("SELECT n_name AS parent, c_custkey AS child, c_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT n_name, NULL, NULL FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)")
def snk1_nested_snapshot(spark, sf_dir):
    """SNK1, PRJ1: nested parents written as pieces of JSON, read again and flattened."""
    out = shared_folder(spark, "snapshot")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    kids = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_name")
    write_snapshot(pieces(n, {"items": kids}, "n_nationkey", {"items": ["c_custkey"]}), "n_nationkey", out)
    back = spark.read.schema("n_nationkey long, segment int, piece long, text string, ends int").json(out)
    items = read_list(back, "n_nationkey", "items", "c_custkey long, c_name string")
    return n.join(items, "n_nationkey", "left").select(F.col("name").alias("parent"), F.col("c_custkey").alias("child"), F.col("c_name").alias("name"))


@query("SELECT 'a' AS label, count(*) AS items FROM part UNION ALL SELECT 'b', count(*) FROM orders")
def snk6_metrics_history(spark, sf_dir):
    out = shared_folder(spark, "history")
    m = lambda label, t: table(spark, sf_dir, t).agg(F.count("*").alias("items")).select(F.lit(label).alias("label"), "items")
    S.append_history(m("a", "part"), out)
    return S.append_history(m("b", "orders"), out)


@query("""SELECT s_suppkey AS source, count(*) AS n, CAST(bool_and(l_suppkey % 2 = 0) AS BOOLEAN) AS enabled FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 2 = 0 AND s_suppkey IN (2, 4, 6, 8, 10) GROUP BY 1""")
def fil10_requested_sources(spark, sf_dir):
    """FIL10, FIL4, JOI5, JOI9: enabled sources of a list of keys."""
    wanted = table(spark, sf_dir, "supplier").filter((F.col("s_suppkey") % 2 == 0) & F.col("s_suppkey").isin(2, 4, 6, 8, 10)).select(F.col("s_suppkey").alias("source"))
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "source").join(wanted, "source", "left_semi")
    return li.groupBy("source").agg(F.count("*").alias("n"), F.bool_and(F.col("source") % 2 == 0).alias("enabled"))


@query("""SELECT p_partkey, CASE WHEN DATE '2026-08-01' + p_size > DATE '2026-08-27' THEN DATE '2026-08-01' + p_size END AS opens_at, regexp_replace('2025-menu', '^(\\d{4})-menu$', '\\1 menu') AS label, list_filter([CASE WHEN p_size % 2 = 0 THEN 'stroll' END, CASE WHEN p_size % 3 = 0 THEN 'new' END], lambda x: x IS NOT NULL)::VARCHAR AS badges FROM part""".replace("list_filter([", "array_to_string(list_filter([").replace("x IS NOT NULL)::VARCHAR", "x IS NOT NULL), ',')"))
def fil11_not_yet_open(spark, sf_dir):
    """FIL11, PRJ3"""
    o = F.date_add(F.lit("2026-08-01").cast("date"), F.col("p_size"))
    badges = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, "stroll"), F.when(F.col("p_size") % 3 == 0, "new")))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(o > F.lit("2026-08-27").cast("date"), o).alias("opens_at"), F.regexp_replace(F.lit("2025-menu"), r"^(\d{4})-menu$", "$1 menu").alias("label"), F.array_join(badges, ",").alias("badges"))


@query("""WITH c(name) AS (SELECT n_name FROM nation), d AS (SELECT DISTINCT lower(n_name) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey % 9 = 0) SELECT name, CASE WHEN lower(name) IN (SELECT k FROM d) THEN 'database' WHEN length(name) > 6 THEN 'research' ELSE 'no data' END AS flag FROM c""")
def prj8_catalogue_coverage(spark, sf_dir):
    """PRJ7, PRJ8"""
    n = table(spark, sf_dir, "nation")
    held = n.join(table(spark, sf_dir, "customer").filter("c_custkey % 9 = 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(F.lower("n_name").alias("k"), F.lit(True).alias("there"))
    out = n.withColumn("k", F.lower("n_name")).join(held, "k", "left")
    return out.select(F.col("n_name").alias("name"), F.when(F.col("there"), "database").when(F.length("n_name") > 6, "research").otherwise("no data").alias("flag"))


@query("""SELECT o_custkey AS url, CAST(o_orderdate AS DATE) AS day, CASE WHEN payload = lag(payload) OVER w THEN NULL ELSE CAST(o_orderdate AS DATE) END AS fresh, o_orderkey FROM (SELECT *, md5(o_orderstatus || o_orderpriority) AS payload FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def win14_stale_stamps(spark, sf_dir):
    """WIN14: a stamp is fresh only where the payload without it has changed."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").withColumn("payload", F.md5(F.concat("o_orderstatus", "o_orderpriority"))).withColumn("day", F.to_date("o_orderdate"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    same = F.coalesce(F.lag("payload").over(w) == F.col("payload"), F.lit(False))
    return o.select(F.col("o_custkey").alias("url"), "day", F.when(~same, F.col("day")).alias("fresh"), "o_orderkey")


@query("SELECT s_name AS name, CASE WHEN s_acctbal > 0 THEN CAST(s_suppkey AS VARCHAR) END AS latitude, s_acctbal > 0 AS has_latitude, true AS has_opens_at FROM supplier WHERE s_suppkey % 4 <> 0")
def src2_curated_parents(spark, sf_dir):
    """SRC2: one file a nation; an absent field, a null and a value are told apart."""
    out = shared_folder(spark, "curated")
    s = table(spark, sf_dir, "supplier")
    row = F.struct(F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit(" "), "s_name")).otherwise(" ").alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")).alias("latitude"), F.lit("x").alias("other"))
    text = F.regexp_replace(F.to_json(F.struct(F.collect_list(row).alias("booths"))), r'"other":"x"', '"opens_at":null,"other":"x"')
    s.groupBy("s_nationkey").agg(text.alias("value")).repartition("s_nationkey").select("value").write.option("maxRecordsPerFile", 1).text(out)
    got = S.overlay_parents(spark, out, ["latitude"], ["opens_at"])
    return got.select("name", F.try_element_at("payload", F.lit("latitude")).alias("latitude"), F.map_contains_key("payload", "latitude").alias("has_latitude"), F.map_contains_key("payload", "opens_at").alias("has_opens_at"))


@query("SELECT p_brand AS booth_name, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'r' || p_partkey END AS rename_to, p_partkey % 10 <> 0 AS kept FROM part WHERE p_partkey % 7 <> 0")
def src3_curated_children(spark, sf_dir):
    """SRC3: rows and rejects of curated children."""
    out = shared_folder(spark, "curated")
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    row = F.struct(F.col("p_brand").alias("booth_name"), F.when(k % 7 != 0, F.col("p_name")).alias("name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("r"), k)).alias("rename_to"), F.when(k % 10 == 0, "iron").otherwise("food").alias("category"))
    p.groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(row).alias("menu_items"))).alias("value")).repartition("p_brand").select("value").write.option("maxRecordsPerFile", 1).text(out)
    rows, rejects = S.overlay_children(spark, out, ["food"])
    return rows.withColumn("kept", F.lit(True)).unionByName(rejects.withColumn("kept", F.lit(False))).select("booth_name", "name", "rename_to", "kept")
