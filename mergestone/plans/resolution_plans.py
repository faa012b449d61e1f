"""Entity resolution over part and customer names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mergestone.functions.text import native_similarity, token_sorted
from mergestone.operators import photos as P
from mergestone.operators import resolution as R
from mergestone.operators.rounds import kept
from mergestone.operators.similarity_join import similar
from mergestone.plans.registry import query, table

#: Longest common subsequence of all ordered pairs of distinct keys, by the rows of the usual table, in SQL.
LCS = """n AS (SELECT DISTINCT array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS k FROM part),
d AS (SELECT x.k AS a, y.k AS b, 0 AS i, list_transform(generate_series(0, length(y.k)), lambda z: 0) AS row FROM n x, n y
UNION ALL SELECT a, b, i + 1, list_reduce(list_prepend([0], list_transform(generate_series(1, length(b)), lambda j: [j])), lambda acc, z: list_append(acc, CASE WHEN a[i + 1] = b[z[1]] THEN row[z[1]] + 1 ELSE greatest(row[z[1] + 1], acc[len(acc)]) END)) FROM d WHERE i < length(a)),
s AS (SELECT a, b, round(200.0 * row[len(row)] / (length(a) + length(b)), 6) AS score FROM d WHERE i = length(a))"""


@query(f"WITH RECURSIVE {LCS} SELECT a, b, score FROM s WHERE a < b AND score >= 70")
def str3_similar_names(spark, sf_dir):
    """STR3, UDF2, ER1: scores of distinct names."""
    n = table(spark, sf_dir, "part").select(F.lit("").alias("block"), token_sorted(F.col("p_name")).alias("a"))
    return similar(n, n.withColumnRenamed("a", "b"), R.REVIEW, once=True).filter("a < b").select("a", "b", "score")


@query(f"WITH RECURSIVE {LCS}, p AS (SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS k, p_brand FROM part), w AS (SELECT p_partkey, k AS a, lag(k) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM p) SELECT p_partkey, score FROM w JOIN s USING (a, b)")
def udf2_native_similarity(spark, sf_dir):
    """UDF2: each part's name against the one before it in its brand, by built-in functions."""
    before = F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    p = table(spark, sf_dir, "part").withColumn("before", before).filter("before is not null")
    pairs = p.select("p_name", "before").distinct().withColumn("score", F.round(native_similarity(F.col("p_name"), F.col("before")), 6))
    return p.join(pairs, ["p_name", "before"]).select("p_partkey", "score")


HEADLINE = "lower(trim(regexp_replace(regexp_replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '[^a-zA-Z0-9]+', ' ', 'g'), ' +', ' ', 'g')))"


def headlines(spark, sf_dir):
    """Pages with their headline's words, in blocks of one: all headlines may meet."""
    words = F.lower(F.trim(F.regexp_replace(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1), "[^a-zA-Z0-9]+", " ")))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("record"), F.lit("").alias("block"), words.alias("key"))


LCS_OF_HEADLINES = f"""h AS (SELECT page_id AS record, {HEADLINE} AS key FROM pages), t AS (SELECT *, array_to_string(list_sort(string_split(key, ' ')), ' ') AS k FROM h), n AS (SELECT DISTINCT k FROM t),
d AS (SELECT x.k AS a, y.k AS b, 0 AS i, list_transform(generate_series(0, length(y.k)), lambda z: 0) AS row FROM n x, n y WHERE x.k < y.k AND 200 * least(length(x.k), length(y.k)) >= 90 * (length(x.k) + length(y.k))
UNION ALL SELECT a, b, i + 1, list_reduce(list_prepend([0], list_transform(generate_series(1, length(b)), lambda j: [j])), lambda acc, z: list_append(acc, CASE WHEN a[i + 1] = b[z[1]] THEN row[z[1]] + 1 ELSE greatest(row[z[1] + 1], acc[len(acc)]) END)) FROM d WHERE i < length(a) AND 200 * (row[len(row)] + length(a) - i) >= 90 * (length(a) + length(b))),
s AS (SELECT a, b, round(200.0 * row[len(row)] / (length(a) + length(b)), 6) AS score FROM d WHERE i = length(a))"""


@query(f"WITH RECURSIVE {LCS_OF_HEADLINES}, p AS (SELECT a, b, score FROM s WHERE score >= 90 UNION ALL SELECT b, a, score FROM s WHERE score >= 90) SELECT k AS a, count(b) AS n_near, max(score) AS best FROM n LEFT JOIN p ON a = k GROUP BY 1")
def er2_similar_headlines(spark, sf_dir):
    """ER2, JOI11: of each headline, how many others are near it, and the best score, through the index of grams."""
    h = kept(headlines(spark, sf_dir).select("block", token_sorted(F.col("key")).alias("a")).distinct(), "headlines")
    near = similar(h, h.withColumnRenamed("a", "b"), R.AUTO, once=True).filter("a < b")
    both = near.select("a", "score").unionByName(near.select(F.col("b").alias("a"), "score")).groupBy("a").agg(F.count("*").alias("n_near"), F.max("score").alias("best"))
    return h.select("a").join(both, "a", "left").select("a", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")


def records(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record"), F.col("p_brand").alias("block"), F.col("p_name").alias("key"))


def entities(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("block"), F.col("p_name").alias("ekey"), (F.col("p_size") > 20).alias("is_active"))


MATCH = f"""{LCS}, r AS (SELECT p_partkey AS record, p_brand AS block, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS k FROM part), e AS (SELECT p_partkey AS entity, p_brand AS block, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS k, p_size > 20 AS live FROM part WHERE p_partkey % 5 = 0),
m AS (SELECT record, entity, score, row_number() OVER (PARTITION BY record ORDER BY score DESC, live DESC, entity) AS j FROM r JOIN e USING (block) JOIN s ON s.a = r.k AND s.b = e.k)"""


@query(f"WITH RECURSIVE {MATCH} SELECT r.record, r.block, CASE WHEN score >= 70 THEN entity END AS entity, score, CASE WHEN score >= 90 THEN 'auto_merge' WHEN score >= 70 THEN 'review' ELSE 'new_entity' END AS outcome FROM r LEFT JOIN m ON m.record = r.record AND j = 1")
def er1_blocked_matching(spark, sf_dir):
    """ER1, ER2, JOI11, SRT4"""
    return R.matched(records(spark, sf_dir), entities(spark, sf_dir)).select("record", "block", "entity", "score", "outcome")


@query(f"""WITH RECURSIVE {MATCH}, o AS (SELECT r.record, CASE WHEN score >= 90 THEN 'auto_merge' WHEN score >= 70 THEN 'review' ELSE 'new_entity' END AS outcome FROM r LEFT JOIN m ON m.record = r.record AND j = 1),
f AS (SELECT record, CASE WHEN record % 7 = 0 AND outcome <> 'auto_merge' THEN 'new_entity' ELSE outcome END AS outcome FROM o) SELECT record, outcome, CASE WHEN outcome = 'new_entity' THEN CASE WHEN record % 50 = 0 THEN 'curated' ELSE 'crawled' END END AS origin FROM f WHERE record % 11 <> 0 OR outcome = 'auto_merge'""")
def er5_flags_and_origin(spark, sf_dir):
    """ER5, ER8"""
    m = R.matched(records(spark, sf_dir), entities(spark, sf_dir))
    k = F.col("record")
    return R.flagged(m.withColumn("new", k % 7 == 0).withColumn("attach_only", k % 11 == 0).withColumn("rank", F.when(k % 50 == 0, 0).otherwise(1))).select("record", "outcome", "origin")


@query(f"""WITH RECURSIVE {MATCH}, o AS (SELECT r.record, CASE WHEN score >= 90 THEN 'auto_merge' WHEN score >= 70 THEN 'review' ELSE 'new_entity' END AS outcome FROM r LEFT JOIN m ON m.record = r.record AND j = 1)
SELECT record FROM o WHERE outcome = 'review' AND record NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)""")
def er6_new_match_conflicts(spark, sf_dir):
    """ER6, ER7: one conflict a record in the review band, but for those that have one."""
    m = R.matched(records(spark, sf_dir), entities(spark, sf_dir)).filter("outcome = 'review'")
    held = table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("record"))
    return m.join(held, "record", "left_anti").select("record")


@query(f"""WITH RECURSIVE {LCS}, r AS (SELECT p_partkey AS record, p_brand AS block, p_name AS key, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS k FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY record) AS i FROM (SELECT block, key, k, min(record) AS record FROM r GROUP BY ALL)),
c AS (SELECT y.block, y.i, list(x.record ORDER BY score DESC, x.record) AS near FROM f y JOIN f x ON x.block = y.block AND x.i < y.i JOIN s ON s.a = x.k AND s.b = y.k AND score >= 90 GROUP BY ALL),
o AS (SELECT f.block, f.key, f.i, f.record, coalesce(near, []) AS near FROM f LEFT JOIN c ON c.block = f.block AND c.i = f.i),
g AS (SELECT block, key, i, record AS leader, [record] AS leaders FROM o WHERE i = 1
UNION ALL SELECT block, key, i, coalesce(held, record), CASE WHEN held IS NULL THEN list_append(leaders, record) ELSE leaders END FROM (SELECT o.*, g.leaders, list_filter(o.near, lambda x: list_contains(g.leaders, x))[1] AS held FROM g JOIN o ON o.block = g.block AND o.i = g.i + 1))
SELECT record, leader FROM r JOIN g USING (block, key)""")
def er4_leader_clusters(spark, sf_dir):
    """ER4, UDF4: in the order of records, a key follows the leader most alike, or leads."""
    return R.leader_clusters(records(spark, sf_dir)).select("record", "leader")


@query(f"""WITH RECURSIVE {LCS_OF_HEADLINES}, f AS (SELECT *, row_number() OVER (ORDER BY record) AS i FROM (SELECT key, k, min(record) AS record FROM t GROUP BY ALL)),
c AS (SELECT y.i, list(x.record ORDER BY coalesce(score, 100) DESC, x.record) AS near FROM f y JOIN f x ON x.i < y.i LEFT JOIN s ON s.a = least(x.k, y.k) AND s.b = greatest(x.k, y.k) AND score >= 90 WHERE score IS NOT NULL OR x.k = y.k GROUP BY ALL),
o AS (SELECT f.key, f.i, f.record, coalesce(near, []) AS near FROM f LEFT JOIN c ON c.i = f.i),
g AS (SELECT key, i, record AS leader, [record] AS leaders FROM o WHERE i = 1
UNION ALL SELECT key, i, coalesce(held, record), CASE WHEN held IS NULL THEN list_append(leaders, record) ELSE leaders END FROM (SELECT o.*, g.leaders, list_filter(o.near, lambda x: list_contains(g.leaders, x))[1] AS held FROM g JOIN o ON o.i = g.i + 1))
SELECT record, leader FROM t JOIN g USING (key)""")
def er4_headline_clusters(spark, sf_dir):
    """ER4, UDF4: the order-exact rule over one block of the whole table."""
    return R.leader_clusters(headlines(spark, sf_dir)).select("record", "leader")


@query("""WITH p AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS name FROM part), l AS (SELECT p_partkey AS id, p_name AS line FROM part) SELECT id, line, (SELECT max_by(name, length(name)) FROM p WHERE line = name OR (starts_with(line, name) AND NOT regexp_matches(substring(line, length(name) + 1, 1), '\\w'))) AS parent FROM l""")
def joi15_longest_prefix_parent(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return R.longest_prefix_parent(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("line")), p.select(F.split("p_name", " ")[0].alias("name")).distinct()).select("id", "line", "parent")


@query("""WITH x AS (SELECT DISTINCT p_brand AS block, p_type AS name FROM part WHERE p_partkey % 3 = 0), e AS (SELECT p_partkey AS id, p_brand AS block, p_type AS old, (SELECT min(p_type) FROM part) AS new FROM part)
SELECT id, CASE WHEN (block, new) IN (SELECT (block, name) FROM x) AND (block, old) NOT IN (SELECT (block, name) FROM x) THEN new ELSE old END AS lookup FROM e""")
def joi12_rename_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    new = p.agg(F.min("p_type").alias("t")).scalar()
    e = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("block"), F.col("p_type").alias("old"), new.alias("new"))
    x = p.filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("block"), F.col("p_type").alias("name"))
    return R.rename_lookup(e, x).select("id", "lookup")


# ------------------------------------------------------------------------------------------------------------- photos


@query("""SELECT parent, dish, photo, season, position FROM (SELECT l_suppkey % 25 AS parent, l_partkey AS dish, l_orderkey AS photo, CAST(year(l_shipdate) AS INT) AS season, l_linenumber AS position, row_number() OVER (PARTITION BY l_suppkey % 25, l_partkey ORDER BY year(l_shipdate) DESC, l_linenumber, l_orderkey) AS k FROM lineitem) WHERE k = 1""")
def win7_first_claims(spark, sf_dir):
    """WIN7, PHO1"""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 25).alias("parent"), F.col("l_partkey").alias("dish"), F.col("l_orderkey").alias("photo"), F.year("l_shipdate").alias("season"), F.col("l_linenumber").alias("position"))
    return P.first_claims(li)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 5 = 0 THEN 'no_parent' WHEN l_partkey % 7 = 0 THEN 'no_dish' WHEN l_linenumber > 4 THEN 'has_photo' ELSE 'attached' END AS outcome, CASE WHEN l_returnflag = 'A' THEN true WHEN l_returnflag = 'N' THEN false ELSE year(l_shipdate) > 1994 END AS may FROM lineitem""")
def pho4_outcomes_and_replacement(spark, sf_dir):
    """PHO1, PHO4"""
    via = F.when(F.col("l_returnflag") == "A", None).when(F.col("l_returnflag") == "N", "other").otherwise("own")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.outcome(F.col("l_suppkey") % 5 != 0, F.col("l_partkey") % 7 != 0, F.col("l_linenumber") > 4).alias("outcome"), P.may_replace(via, F.lit(1994), F.year("l_shipdate")).alias("may"))


@query("""WITH c AS (SELECT l_partkey AS item, l_orderkey * 10 + l_linenumber AS ref, l_suppkey % 3 = 0 AS curated, l_returnflag = 'N' AS by_hand, CAST(year(l_shipdate) AS INT) AS season, l_linenumber = 1 AS served FROM lineitem),
f AS (SELECT item, bool_or(served AND curated AND NOT by_hand AND season < 1997) AS old, bool_or(NOT curated AND season = 1997) AS fresh FROM c GROUP BY item) SELECT c.item, c.ref FROM c JOIN f USING (item) WHERE NOT (old AND fresh AND curated AND NOT by_hand AND season < 1997)""")
def pho5_promotion(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = li.select(F.col("l_partkey").alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), (F.col("l_suppkey") % 3 == 0).alias("curated"), (F.col("l_returnflag") == "N").alias("by_hand"), F.year("l_shipdate").alias("season"), (F.col("l_linenumber") == 1).alias("served"))
    return P.promoted(c, 1997).select("item", "ref")


@query("""WITH i AS (SELECT l_partkey AS item, max(l_returnflag) AS value FROM lineitem GROUP BY 1), f AS (SELECT l_partkey AS item, l_returnflag AS value, min(l_orderkey) AS ref FROM lineitem GROUP BY ALL),
u AS (SELECT page_id AS ref, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages) SELECT item, i.value, ref, url, host, coalesce(CASE WHEN host LIKE 'blog.%' THEN 'The blog' END, host) AS credit FROM i LEFT JOIN f USING (item, value) LEFT JOIN u USING (ref)""")
def pho6_attribution(spark, sf_dir):
    """PHO6, JOI10, STR16"""
    from mergestone.functions.text import host_key

    li = table(spark, sf_dir, "lineitem")
    items = li.groupBy(F.col("l_partkey").alias("item")).agg(F.max("l_returnflag").alias("value"))
    c = li.select(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("value"), F.col("l_orderkey").alias("ref"))
    pages = table(spark, sf_dir, "pages")
    credits = pages.select(host_key(F.col("url")).alias("host")).distinct().filter("host like 'blog.%'").withColumn("credit", F.lit("The blog"))
    return P.attributed(items, c, pages.select(F.col("page_id").alias("ref"), "url"), credits).select("item", "value", "ref", "url", "host", "credit")


@query("""WITH s AS (SELECT l_orderkey AS photo, l_partkey AS dish, max(CAST(l_quantity * 2 AS INT)) AS score, l_suppkey % 2 AS own FROM lineitem GROUP BY ALL), a AS (SELECT photo, dish FROM (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY score DESC, dish) AS k FROM s WHERE own = 0 AND score >= 90) WHERE k = 1),
w AS (SELECT photo, dish, score FROM (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY score DESC, dish) AS k FROM s WHERE own = 1 AND score >= 90) WHERE k = 1), u AS (SELECT w.photo FROM w JOIN s ON s.photo = w.photo AND s.own = 1 AND s.score = w.score GROUP BY 1 HAVING count(*) = 1),
b AS (SELECT photo, dish FROM w WHERE photo IN (SELECT photo FROM u) AND photo NOT IN (SELECT photo FROM a) AND dish NOT IN (SELECT dish FROM a)), c AS (SELECT photo, dish, 1 AS stage FROM a UNION ALL SELECT photo, dish, 2 FROM b)
SELECT photo, dish, stage FROM (SELECT *, row_number() OVER (PARTITION BY dish ORDER BY stage, photo) AS k FROM c) WHERE k = 1""")
def pho3_two_stage_match(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("photo"), F.col("l_partkey").alias("dish"), (F.col("l_suppkey") % 2).alias("own")).agg(F.max((F.col("l_quantity") * 2).cast("int")).alias("score"))
    return P.two_stage(s.select("photo", "dish"), s.filter("own = 0").drop("own"), s.filter("own = 1").drop("own"))


@query("""WITH RECURSIVE g AS (SELECT p_brand, lower(min(p_name)) AS name FROM part GROUP BY 1), r AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS caption, lower(p_name) AS head, name FROM part JOIN g USING (p_brand)),
t AS (SELECT p_partkey, caption, name, array_to_string(list_sort(string_split(caption, ' ')), ' ') AS x, array_to_string(list_sort(string_split(head, ' ')), ' ') AS h, array_to_string(list_sort(string_split(name, ' ')), ' ') AS y FROM r),
n AS (SELECT x AS a, y AS b FROM t UNION SELECT h, y FROM t),
d AS (SELECT a, b, 0 AS i, list_transform(generate_series(0, length(b)), lambda z: 0) AS row FROM n
UNION ALL SELECT a, b, i + 1, list_reduce(list_prepend([0], list_transform(generate_series(1, length(b)), lambda j: [j])), lambda acc, z: list_append(acc, CASE WHEN a[i + 1] = b[z[1]] THEN row[z[1]] + 1 ELSE greatest(row[z[1] + 1], acc[len(acc)]) END)) FROM d WHERE i < length(a)),
s AS (SELECT a, b, 200.0 * row[len(row)] / (length(a) + length(b)) AS score FROM d WHERE i = length(a))
SELECT p_partkey, round(greatest(u.score, v.score, CASE WHEN starts_with(caption, name || ' ') OR (len(string_split(name, ' ')) >= 3 AND list_has_all(string_split(caption, ' '), string_split(name, ' '))) THEN 90.0 ELSE 0.0 END), 6) AS score FROM t JOIN s u ON u.a = x AND u.b = y JOIN s v ON v.a = h AND v.b = y""")
def pho2_guide_scores(spark, sf_dir):
    """PHO2: captions made of two names, scored against the first name of their brand."""
    p = table(spark, sf_dir, "part")
    name = p.groupBy("p_brand").agg(F.min("p_name").alias("name"))
    r = p.join(name, "p_brand").withColumn("full", F.concat_ws(" ", "p_name", "p_type"))
    return r.select("p_partkey", F.round(P.guide_score(F.lower("full"), F.lower("p_name"), F.lower("name")), 6).alias("score"))


@query("""SELECT p_partkey, 'photo-' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '.png' ELSE '.jpg' END AS file, p_brand AS parent FROM part WHERE p_size % 3 = 0""")
def pho7_photo_export(spark, sf_dir):
    """PHO7, SNK4's rows"""
    from mergestone.functions.text import extension_of

    url = F.when(F.col("p_size") % 2 == 0, "https://x/a.png?w=3").otherwise("https://x/a")
    return table(spark, sf_dir, "part").filter("p_size % 3 = 0").select("p_partkey", F.concat(F.lit("photo-"), "p_partkey", extension_of(url)).alias("file"), F.col("p_brand").alias("parent"))


@query("""SELECT 'id' || s_suppkey AS public_id, CASE WHEN s_suppkey % 2 = 0 THEN '/a/id' || s_suppkey || '.jpg' END AS path, s_suppkey % 2 = 0 AS returned FROM supplier""")
def pho8_returned_files(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    files = s.filter("s_suppkey % 2 = 0").select(F.explode(F.array(F.concat(F.lit("/b/id"), "s_suppkey", F.lit(".png")), F.concat(F.lit("/a/id"), "s_suppkey", F.lit(".jpg")))).alias("path"))
    return P.reconciled_files(s.select(F.concat(F.lit("id"), "s_suppkey").alias("public_id")), files)
