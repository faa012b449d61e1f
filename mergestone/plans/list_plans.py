"""Lists, search, facets, snapshots and dimensions: brands are parents, parts their children, suppliers sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mergestone.functions.text import host_key
from mergestone.functions.vocabulary import TAG_LABELS
from mergestone.operators import lists as L
from mergestone.operators.overlay import digest
from mergestone.plans.registry import query, table

LABELS = ", ".join(f"('{c}', '{a}', '{k}')" for c, (a, k) in TAG_LABELS.items())


def filtered(spark, sf_dir, brand="", text="", low=None, high=None):
    p = table(spark, sf_dir, "part")
    return L.optional_filter(p, brand=(brand, F.col("p_brand") == brand, False), text=(text, L.contains("p_name", text), False), low=(low, F.col("p_retailprice") >= low, True), high=(high, F.col("p_retailprice") <= high, True))


@query("""SELECT p_partkey, p_name, p_brand, (SELECT count(*) FROM part WHERE p_name ILIKE '%a_e%' AND p_retailprice >= 0 AND p_retailprice <= 1500) AS total FROM part WHERE p_name ILIKE '%a_e%' AND p_retailprice >= 0 AND p_retailprice <= 1500 ORDER BY p_name, p_partkey LIMIT 10 OFFSET 10""")
def fil1_filtered_page(spark, sf_dir):
    """FIL1, FIL2, FIL3, AGG1, SRT1"""
    rows = filtered(spark, sf_dir, brand="", text="a_e", low=0, high=1500).select("p_partkey", "p_name", "p_brand")
    return L.page(rows, ["p_name", "p_partkey"], 2, 10)  # a page is the feature


@query("""SELECT s_name, n_name, r_name, count(*) AS lines, sum(CAST(l_quantity AS BIGINT)) AS units FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE l_shipdate >= DATE '1995-01-01' GROUP BY ALL""")
def joi1_lines_by_source(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp_ntz '1995-01-01'")
    per = li.groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("units"))
    s = per.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return s.join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("s_name", "n_name", "r_name").agg(F.sum("lines").alias("lines"), F.sum("units").alias("units"))


@query("""SELECT DISTINCT p_partkey, p_name FROM part, LATERAL unnest(string_split(p_name, ' ')) t(tag) WHERE tag IN (SELECT min(x) FROM (SELECT unnest(string_split(p_name, ' ')) AS x FROM part))""")
def joi2_items_with_tag(spark, sf_dir):
    """JOI2: through a many-to-many bridge to a tag code, as a semi-join that repeats no item."""
    p = table(spark, sf_dir, "part")
    bridge = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("tag"))
    wanted = bridge.agg(F.min("tag").alias("tag"))
    return p.join(bridge.join(wanted, "tag", "left_semi"), "p_partkey", "left_semi").select("p_partkey", "p_name")


SEARCH = "SELECT * FROM (SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation) WHERE name ILIKE '%r%'"


@query(f"SELECT kind, id, name FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS k FROM ({SEARCH})) WHERE k <= 25")
def set1_search(spark, sf_dir):
    """SRT5. SET1, SRT2: one search over four kinds, 25 of each."""
    t = lambda kind, name, id_, label: table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(id_).cast("long").alias("id"), F.col(label).alias("name"))
    every = t("part", "part", "p_partkey", "p_name").unionByName(t("supplier", "supplier", "s_suppkey", "s_name")).unionByName(t("customer", "customer", "c_custkey", "c_name")).unionByName(t("nation", "nation", "n_nationkey", "n_name"))
    return L.top_each(every.filter(L.contains("name", "r")), "kind", ["id"], 25).drop("place")


@query("""WITH f AS (SELECT CAST(year(o_orderdate) AS INT) AS id, min(CAST(o_orderdate AS DATE)) AS s, max(CAST(o_orderdate AS DATE)) - 40 AS e FROM orders GROUP BY 1)
SELECT d.day, x.id, x.branch FROM (VALUES ('1996-06-01'), ('1997-12-20'), ('2030-01-01')) d(day), LATERAL (SELECT id, CASE WHEN s <= CAST(day AS DATE) AND e >= CAST(day AS DATE) THEN 0 WHEN s > CAST(day AS DATE) THEN 1 ELSE 2 END AS branch FROM f
ORDER BY branch, CASE WHEN s <= CAST(day AS DATE) AND e >= CAST(day AS DATE) THEN -epoch(s) WHEN s > CAST(day AS DATE) THEN epoch(s) ELSE -id END LIMIT 1) x""")
def fil7_current_season(spark, sf_dir):
    f = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("id")).agg(F.min(F.to_date("o_orderdate")).alias("start"), F.date_sub(F.max(F.to_date("o_orderdate")), 40).alias("end")).withColumn("year", F.col("id"))
    out = None
    for day in ("1996-06-01", "1997-12-20", "2030-01-01"):
        one = L.current_by_dates(f, day).withColumn("day", F.lit(day))
        out = one if out is None else out.unionByName(one)
    return out.select("day", "id", "branch")


@query("""WITH c AS (SELECT p_brand AS parent, count(*) FILTER (p_type = (SELECT min(p_type) FROM part) AND contains(lower(p_name), 'e')) AS n_match, count(*) AS n_all FROM part GROUP BY 1)
SELECT parent, CASE WHEN contains(lower(parent), '#1') THEN n_all ELSE n_match END AS n_shown, contains(lower(parent), '#1') OR n_match > 0 AS shown FROM c""")
def fil9_visible_parents(spark, sf_dir):
    """FIL8, FIL9"""
    p = table(spark, sf_dir, "part")
    kind = p.agg(F.min("p_type").alias("p_type")).scalar()
    kids = p.select(F.col("p_brand").alias("parent"), ((F.col("p_type") == kind) & F.lower("p_name").contains("e")).alias("match"))
    return L.visible_parents(p.select(F.col("p_brand").alias("parent")).distinct(), kids, "#1", facets=False)


@query("""SELECT o_orderstatus AS status, o_orderkey, CAST(o_orderdate AS DATE) AS opened_at FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def fil13_newest_by_status(spark, sf_dir):
    """FIL13, SRT3"""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P")).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    return o.select(F.col("o_orderstatus").alias("status"), "o_orderkey", F.to_date("o_orderdate").alias("opened_at"))


@query("""WITH r AS (SELECT p_partkey AS id, p_size % 4 = 0 AS unplaced, p_size % 3 = 0 AS no_photo, p_partkey % 5 = 0 AS is_new, p_name, p_brand FROM part)
SELECT count(*) FILTER (unplaced) AS unplaced, count(*) FILTER (no_photo AND is_new) AS new_without_photo, count(*) FILTER (contains(lower(p_name || ' ' || p_brand), '#2')) AS by_text FROM r""")
def fil14_completeness(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").agg(F.count_if(s % 4 == 0).alias("unplaced"), F.count_if((s % 3 == 0) & (k % 5 == 0)).alias("new_without_photo"), F.count_if(F.lower(F.concat_ws(" ", "p_name", "p_brand")).contains("#2")).alias("by_text"))


@query("""SELECT b.p_brand AS parent, CAST(coalesce(n, 0) AS BIGINT) AS n_items, coalesce(items, '') AS items FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN (SELECT p_brand, count(*) AS n, string_agg(p_partkey || ':' || p_name, ';' ORDER BY p_partkey) AS items FROM part WHERE p_size > 40 GROUP BY 1) c USING (p_brand)""")
def joi3_nested_children(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "parent")
    n = L.nested(p.select("parent").distinct(), p.filter("p_size > 40"), "parent", ["p_partkey", "p_name"])
    return n.select("parent", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["p_partkey"], x["p_name"])), ";").alias("items"))


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","id":' || p_partkey || ',"note":null,"size":' || p_size || '}' AS line FROM part""")
def snk2_canonical_json(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.lit(None).cast("string").alias("note"))
    return p.select("p_partkey", L.canonical_json(p, ["size", "id", "note", "brand"]).alias("line"))


@query("""WITH r AS (SELECT sha256(to_json({'p_brand': p_brand, 'p_name': p_name, 'p_partkey': p_partkey, 'p_size': p_size})) AS h FROM part),
s AS (SELECT count(*) AS n, sum(('0x' || h[1:12])::BIGINT) AS s0, sum(('0x' || h[13:24])::BIGINT) AS s1, sum(('0x' || h[25:36])::BIGINT) AS s2, sum(('0x' || h[37:48])::BIGINT) AS s3 FROM r) SELECT n, sha256(concat_ws('-', n, s0, s1, s2, s3))[1:32] AS digest FROM s""")
def hsh2_table_digest(spark, sf_dir):
    """HSH2, HSH3: equal for any order and partitioning of the same rows."""
    return digest(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_brand", "p_size")


@query(f"""WITH l(code, label, kind) AS (VALUES {LABELS}), c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'vegan' WHEN 1 THEN 'contains_nuts' WHEN 2 THEN 'sweet' ELSE 'extra_hot_stuff' END AS code FROM part)
SELECT p_partkey, code, coalesce(label, 'Extra Hot Stuff') AS label, coalesce(kind, 'dietary') AS kind FROM c LEFT JOIN l USING (code)""")
def prj5_tag_labels(spark, sf_dir):
    """PRJ4, PRJ5, STR10: labels by a small fixed dimension, an unknown code in title case."""
    from mergestone.functions.text import code_label

    k = F.col("p_partkey") % 4
    c = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, "vegan").when(k == 1, "contains_nuts").when(k == 2, "sweet").otherwise("extra_hot_stuff").alias("code"))
    d = spark.createDataFrame([(a, *b) for a, b in TAG_LABELS.items()], "code string, label string, kind string")
    return c.join(F.broadcast(d), "code", "left").select("p_partkey", "code", F.coalesce("label", code_label(F.col("code"))).alias("label"), F.coalesce("kind", F.lit("dietary")).alias("kind"))


@query("""SELECT p_brand AS parent, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS position, printf('%.2f', p_retailprice) AS price, coalesce(nullif(p_type, ''), 'food') AS category FROM part WHERE p_size % 7 <> 0""")
def prj2_client_rows(spark, sf_dir):
    """PRJ2, WIN13, MAT5: positions in source order and prices as text."""
    p = table(spark, sf_dir, "part").filter("p_size % 7 <> 0")
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("long")
    return p.select(F.col("p_brand").alias("parent"), "p_partkey", n.alias("position"), F.format_string("%.2f", "p_retailprice").alias("price"), F.coalesce(F.nullif("p_type", F.lit("")), F.lit("food")).alias("category"))


@query("""WITH c AS (SELECT c_custkey AS id, (c_custkey % 180) - 90.0 AS lat, (c_custkey * 7 % 360) - 180.0 AS lon FROM customer), s AS (SELECT s_suppkey AS sid, (s_suppkey * 3 % 180) - 90.0 AS lat2, (s_suppkey * 11 % 360) - 180.0 AS lon2 FROM supplier)
SELECT id, sid AS nearest FROM (SELECT id, sid, row_number() OVER (PARTITION BY id ORDER BY round(2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2)))), 0), sid) AS k FROM c, s) WHERE k = 1""")
def srt6_nearest_place(spark, sf_dir):
    """SRT6, MAT3: for every customer the nearest of all suppliers, found among the places of the cells around it."""
    k, n = F.col("c_custkey"), F.col("s_suppkey")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), (k % 180 - 90.0).cast("double").alias("lat"), (k * 7 % 360 - 180.0).cast("double").alias("lon"))
    s = table(spark, sf_dir, "supplier").select(n.alias("place"), (n * 3 % 180 - 90.0).cast("double").alias("lat2"), (n * 11 % 360 - 180.0).cast("double").alias("lon2"))
    return L.nearest(c, s)


@query("""SELECT p_brand, CASE WHEN count(*) > 8 THEN array_to_string(list_sort(list(p_name || '#' || p_partkey))[1:8], ', ') || ' and ' || (count(*) - 8) || ' more' ELSE array_to_string(list_sort(list(p_name || '#' || p_partkey)), ', ') END AS labels FROM part GROUP BY 1""")
def srt8_shortened_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    w = Window.partitionBy("p_brand").orderBy("label")
    first = p.withColumn("label", F.concat_ws("#", "p_name", "p_partkey")).withColumn("k", F.row_number().over(w))
    # of a group no more than eight labels are gathered
    g = first.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.when(F.col("k") <= 8, F.col("label")))).alias("l"), F.count("*").alias("n"))
    return g.select("p_brand", L.shortened(F.col("l"), total=F.col("n")).alias("labels"))


@query("""SELECT p_partkey, CASE p_type WHEN (SELECT min(p_type) FROM part) THEN 0 ELSE 1 END AS grade, dense_rank() OVER (ORDER BY CASE p_type WHEN (SELECT min(p_type) FROM part) THEN 0 ELSE 1 END, lower(p_brand)) AS place FROM part""")
def srt7_grade_order(spark, sf_dir):
    """SRT7: the order is found on the few distinct keys and joined back."""
    p = table(spark, sf_dir, "part")
    kind = p.agg(F.min("p_type").alias("p_type")).scalar()
    p = p.withColumn("grade", F.when(F.col("p_type") == kind, 0).otherwise(1)).withColumn("b", F.lower("p_brand"))
    places = p.select("grade", "b").distinct().withColumn("place", F.row_number().over(Window.orderBy("grade", "b")).cast("long"))
    return p.join(places, ["grade", "b"]).select("p_partkey", "grade", "place")


@query("""SELECT DISTINCT tag FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part WHERE p_size > 10)""")
def agg16_facet_values(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size > 10").select(F.explode(F.split("p_name", " ")).alias("tag")).distinct()


@query("""SELECT count(*) FILTER (n_regionkey = 0) AS surveyed, count(*) FILTER (n_regionkey = 1) AS mapped, count(*) FILTER (n_regionkey = 2) AS anchored, count(*) FILTER (n_regionkey > 2) AS unplaced FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def agg13_precision_tallies(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    r = F.col("n_regionkey")
    return j.agg(F.count_if(r == 0).alias("surveyed"), F.count_if(r == 1).alias("mapped"), F.count_if(r == 2).alias("anchored"), F.count_if(r > 2).alias("unplaced"))


@query("""WITH s AS (SELECT p_partkey AS id FROM part WHERE p_size < 25), t AS (SELECT l_partkey AS id FROM lineitem WHERE l_suppkey % 8 = 0), c AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 40 = 0)
SELECT 'both' AS what, count(*) AS n FROM (SELECT id FROM s INTERSECT SELECT id FROM t) UNION ALL SELECT 'either', count(*) FROM (SELECT id FROM t UNION SELECT id FROM c) UNION ALL SELECT 'only', count(*) FROM (SELECT id FROM s EXCEPT SELECT id FROM t)""")
def set2_set_operations(spark, sf_dir):
    """SET2, SET3, SET4"""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    s, c = p.filter("p_size < 25").select("id"), p.filter("id % 40 = 0").select("id")
    t = table(spark, sf_dir, "lineitem").filter("l_suppkey % 8 = 0").select(F.col("l_partkey").alias("id"))
    n = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n("both", s.intersect(t)).unionByName(n("either", t.union(c).distinct())).unionByName(n("only", s.subtract(t)))


@query("""SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(string_split(m, ' '), x))) = 0 AS inside, list_sort(string_split(p_name, ' ')) = list_sort(string_split(m, ' ')) AS same FROM part, (SELECT max(p_name) AS m FROM part)""")
def set5_word_sets(spark, sf_dir):
    """SET5, SET6"""
    p = table(spark, sf_dir, "part")
    m, w = F.split("m", " "), F.split("p_name", " ")
    return p.withColumn("m", p.agg(F.max("p_name").alias("m")).scalar()).select("p_partkey", (F.size(F.array_except(w, m)) == 0).alias("inside"), (F.array_sort(w) == F.array_sort(m)).alias("same"))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages), s AS (SELECT host, min(page_id) AS source FROM h WHERE page_id % 3 = 0 GROUP BY 1) SELECT page_id, host, source FROM h LEFT JOIN s USING (host)""")
def joi8_host_match(spark, sf_dir):
    """JOI8, STR12: pages to the source of their host, the lowest rank first."""
    h = table(spark, sf_dir, "pages").select("page_id", host_key(F.col("url")).alias("host"))
    s = h.filter("page_id % 3 = 0").groupBy("host").agg(F.min("page_id").alias("source"))
    return h.join(s, "host", "left").select("page_id", "host", "source")


@query("""WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) SELECT c.p_partkey AS child, p.p_partkey AS parent FROM part c JOIN p ON p.k = 1 AND trim(p.p_brand) = trim(c.p_brand)""")
def joi14_first_parent_by_name(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("name", F.trim("p_brand"))
    first = p.groupBy("name").agg(F.min("p_partkey").alias("parent"))
    return p.join(first, "name").select(F.col("p_partkey").alias("child"), "parent")


@query("""SELECT p_partkey, status FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'stored' WHEN DATE '2000-01-01' + p_size > DATE '2000-01-30' THEN 'upcoming' WHEN DATE '2000-01-10' + p_size < DATE '2000-01-30' THEN 'ended' ELSE 'running' END AS status FROM part)""")
def dat1_status_on_day(spark, sf_dir):
    s = F.when(F.col("p_size") % 5 != 0, F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size")))
    e = F.date_add(F.lit("2000-01-10").cast("date"), F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", L.status_on(s, e, F.lit("2000-01-30").cast("date"), F.lit("stored")).alias("status"))


@query("""SELECT n_name AS name, r_name AS region, row_number() OVER (ORDER BY r_name DESC, n_name) AS place FROM nation JOIN region ON r_regionkey = n_regionkey""")
def pub4_dimension_listing(spark, sf_dir):
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.select(F.col("n_name").alias("name"), F.col("r_name").alias("region"), F.row_number().over(Window.orderBy(F.desc("r_name"), "n_name")).cast("long").alias("place"))


@query("""SELECT o.o_orderkey, o.o_orderstatus, count(l_orderkey) AS n_lines FROM orders o LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = (SELECT min(o_custkey) FROM orders) GROUP BY ALL""")
def pub3_lookup_with_children(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    one = o.filter(F.col("o_custkey") == o.agg(F.min("o_custkey").alias("k")).scalar())
    return one.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey", "o_orderstatus").agg(F.count("l_orderkey").alias("n_lines"))


@query("""WITH f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 304 WHEN 1 THEN 500 ELSE 200 END AS status FROM pages) SELECT CASE WHEN status = 304 THEN 'unchanged' WHEN status BETWEEN 200 AND 299 THEN 'stored' ELSE 'error' END AS outcome, count(*) AS n FROM f GROUP BY 1""")
def fil12_fetch_outcomes(spark, sf_dir):
    s = F.when(F.col("page_id") % 5 == 0, 304).when(F.col("page_id") % 5 == 1, 500).otherwise(200)
    return table(spark, sf_dir, "pages").select(F.when(s == 304, "unchanged").when(s.between(200, 299), "stored").otherwise("error").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE (event_id % 10 = 0 OR ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events)) AND regexp_matches(event_type || ' ' || props, '(?i)k.*[37]')""")
def src5_feed_since(spark, sf_dir):
    """SRC5, FIL10: recent or undated entries whose text matches."""
    e = table(spark, sf_dir, "events")
    since = e.agg((F.max("ts") - F.expr("interval 7 days")).alias("s")).scalar()
    published = F.when(F.col("event_id") % 10 != 0, F.col("ts"))
    return e.filter((published.isNull() | (published >= since)) & F.concat_ws(" ", "event_type", "props").rlike("(?i)k.*[37]")).select("event_id", F.to_date("ts").alias("day"))
