"""Overlays and changesets over parts: payloads are maps of a part's fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from mergestone.operators import overlay as O
from mergestone.operators.changesets import applied
from mergestone.plans.registry import query, table

BASE = "b AS (SELECT p_partkey AS k, p_name AS name, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN CAST(p_size AS VARCHAR) END AS size FROM part WHERE p_partkey % 5 <> 0)"
NEW = "n AS (SELECT p_partkey AS k, 'new' AS size, p_brand AS note FROM part WHERE p_partkey % 2 = 0)"


def base(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0")
    size = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_size").cast("string"))
    return p.select(F.col("p_partkey").alias("k"), F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), size).alias("payload"))


def new(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0")
    return p.select(F.col("p_partkey").alias("k"), F.create_map(F.lit("size"), F.lit("new"), F.lit("note"), F.col("p_brand")).alias("payload"))


def shown(df):
    at = lambda f: F.try_element_at("payload", F.lit(f)).alias(f)
    return df.select("k", at("name"), at("size"), at("note"), "how")


HOW = "CASE WHEN b.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'untouched' ELSE 'merged' END AS how"


@query(f"WITH {BASE}, {NEW} SELECT k, b.name, CASE WHEN b.k IS NULL OR (n.k IS NOT NULL AND (b.size IS NULL OR b.size = '')) THEN n.size ELSE b.size END AS size, n.note, {HOW} FROM b FULL JOIN n USING (k)")
def ups1_fill_falsy(spark, sf_dir):
    return shown(O.merged(base(spark, sf_dir), new(spark, sf_dir), ["k"], overwrite=False))


@query(f"WITH {BASE}, {NEW} SELECT k, b.name, CASE WHEN b.k IS NULL THEN n.size ELSE b.size END AS size, n.note, {HOW} FROM b FULL JOIN n USING (k)")
def ups2_fill_absent(spark, sf_dir):
    return shown(O.merged(base(spark, sf_dir), new(spark, sf_dir), ["k"], overwrite=False, fill="absent"))


@query(f"WITH {BASE}, {NEW} SELECT k, b.name, CASE WHEN n.k IS NOT NULL THEN n.size ELSE b.size END AS size, n.note, {HOW} FROM b FULL JOIN n USING (k)")
def snk5_overwrite(spark, sf_dir):
    return shown(O.merged(base(spark, sf_dir), new(spark, sf_dir), ["k"], overwrite=True))


@query(f"""WITH {BASE}, {NEW} SELECT k, CASE WHEN b.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'deleted' ELSE 'edited' END AS kind, CASE WHEN b.k IS NULL THEN 2 WHEN n.k IS NULL THEN -1 ELSE 2 END AS n_fields FROM b FULL JOIN n USING (k)""")
def ups6_changed_fields(spark, sf_dir):
    """UPS6, UPS9"""
    return O.changed_fields(base(spark, sf_dir), new(spark, sf_dir), "k").select("k", "kind", F.coalesce(F.size("fields"), F.lit(-1)).alias("n_fields"))


PENDING = "p AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.0' WHEN 1 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS value, p_partkey % 7 = 0 AS deleted FROM part)"


@query(f"WITH {PENDING}, b AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS had FROM part WHERE p_partkey % 3 <> 0) SELECT p.k, 'size' AS field, value, deleted FROM p LEFT JOIN b USING (k) WHERE NOT (CASE WHEN deleted THEN had IS NULL ELSE had IS NOT NULL AND p.k % 4 <> 1 END)")
def ups7_settled_edits(spark, sf_dir):
    """UPS7, MAT6"""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    s = F.col("p_size").cast("string")
    pending = p.select(k.alias("k"), F.lit("size").alias("field"), F.when(k % 4 == 0, F.concat(s, F.lit(".0"))).when(k % 4 == 1, "x").otherwise(s).alias("value"), (k % 7 == 0).alias("deleted"))
    return O.settled(pending, p.filter("p_partkey % 3 <> 0").select(k.alias("k"), F.lit("size").alias("field"), s.alias("value")), "k")


CHANGES = """c AS (SELECT 'n' || p_partkey AS name, CASE WHEN p_partkey % 10 = 0 THEN 'n' || (p_partkey + 1) WHEN p_partkey % 10 = 2 THEN 'r' || p_partkey END AS rename_to, CASE WHEN p_partkey % 6 = 0 THEN 'odd' WHEN p_partkey % 6 = 2 THEN 'food' END AS category, p_size AS price, p_partkey % 8 = 0 AS is_new, p_partkey % 8 = 2 AS is_deleted FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT 'n' || p_partkey AS name, p_type AS category, 1 AS price FROM part WHERE p_partkey % 4 <> 0),
r AS (SELECT c.*, CASE WHEN category = 'odd' THEN 'unknown category' WHEN is_new AND name IN (SELECT name FROM b) THEN 'already there' WHEN NOT is_new AND name NOT IN (SELECT name FROM b) THEN 'not there' WHEN rename_to IN (SELECT name FROM b) THEN 'name taken' END AS reason FROM c),
s AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN is_deleted THEN 'deleted' WHEN is_new THEN 'added' ELSE 'kept' END AS status FROM r)"""


def changeset(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    n = lambda x, a="n": F.concat(F.lit(a), x)
    c = p.filter("p_partkey % 2 = 0").select(n(k).alias("name"), F.when(k % 10 == 0, n(k + 1)).when(k % 10 == 2, n(k, "r")).alias("rename_to"), F.when(k % 6 == 0, "odd").when(k % 6 == 2, "food").alias("category"), F.col("p_size").cast("int").alias("price"), (k % 8 == 0).alias("is_new"), (k % 8 == 2).alias("is_deleted"))
    return p.filter("p_partkey % 4 <> 0").select(n(k).alias("name"), F.col("p_type").alias("category"), F.lit(1).alias("price")), c


@query(f"WITH {CHANGES} SELECT name, status, reason FROM s")
def ups4_changeset_report(spark, sf_dir):
    return applied(*changeset(spark, sf_dir), ["food", "drink"])[1].select("name", "status", "reason")


@query(f"""WITH {CHANGES} SELECT coalesce(s.rename_to, b.name) AS name, coalesce(s.category, b.category) AS category, coalesce(s.price, b.price) AS price FROM b LEFT JOIN s ON s.name = b.name AND s.status IN ('kept', 'deleted') WHERE coalesce(s.status, '') <> 'deleted'
UNION ALL SELECT name, category, price FROM s WHERE status = 'added'""")
def ups3_changeset_result(spark, sf_dir):
    return applied(*changeset(spark, sf_dir), ["food", "drink"])[0]


#: Orders as entries whose names collide: one in three gives a name another may hold, free or take.
ORDERED = """e AS (SELECT o_custkey % 1000 AS scope, o_orderkey AS seq, 'n' || (o_custkey // 1000 + o_orderkey % 5) AS name, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey // 3 % 7 <> o_custkey // 1000 + o_orderkey % 5 THEN 'n' || (o_orderkey // 3 % 7) END AS rename_to, CASE CAST(floor(o_totalprice) AS BIGINT) % 10 WHEN 0 THEN 'odd' WHEN 1 THEN 'food' WHEN 2 THEN 'drink' END AS category, CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_totalprice) AS INT) END AS price, o_orderkey % 7 = 2 AS is_new, o_orderkey % 7 = 3 AS is_deleted FROM orders),
b AS (SELECT DISTINCT c_custkey % 1000 AS scope, 'n' || k AS name FROM customer, range(0, 7, 2) r(k)),
o AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seq) AS i FROM e),
g AS (SELECT scope, 0 AS i, list({'name': name, 'category': 'drink', 'price': 1} ORDER BY name) AS held, NULL::BIGINT AS seq, NULL::VARCHAR AS name, NULL::VARCHAR AS reason FROM b GROUP BY scope
UNION ALL SELECT g.scope, o.i, CASE WHEN w.reason IS NOT NULL THEN held WHEN is_new THEN list_append(held, {'name': o.name, 'category': category, 'price': price}) WHEN is_deleted THEN list_filter(held, lambda x: x.name <> o.name)
ELSE list_transform(held, lambda x: CASE WHEN x.name = o.name THEN {'name': coalesce(rename_to, o.name), 'category': coalesce(category, x.category), 'price': coalesce(price, x.price)} ELSE x END) END, o.seq, o.name, w.reason
FROM g JOIN o ON o.scope = g.scope AND o.i = g.i + 1, LATERAL (SELECT CASE WHEN category = 'odd' THEN 'unknown category' WHEN is_new AND list_contains(list_transform(held, lambda x: x.name), o.name) THEN 'already there' WHEN NOT is_new AND NOT list_contains(list_transform(held, lambda x: x.name), o.name) THEN 'not there' WHEN list_contains(list_transform(held, lambda x: x.name), rename_to) THEN 'name taken' END AS reason) w)"""


def ordered_changeset(spark, sf_dir):
    n = lambda x: F.concat(F.lit("n"), F.expr(x))
    whole = F.floor("o_totalprice")
    c = table(spark, sf_dir, "orders").select(
        F.expr("o_custkey % 1000 AS scope"), F.col("o_orderkey").alias("seq"), n("o_custkey div 1000 + o_orderkey % 5").alias("name"), F.when(F.expr("o_orderkey % 3 = 0 AND o_orderkey div 3 % 7 <> o_custkey div 1000 + o_orderkey % 5"), n("o_orderkey div 3 % 7")).alias("rename_to"),
        F.when(whole % 10 == 0, "odd").when(whole % 10 == 1, "food").when(whole % 10 == 2, "drink").alias("category"), F.when(F.col("o_orderkey") % 2 == 0, whole.cast("int")).alias("price"), F.expr("o_orderkey % 7 = 2 AS is_new"), F.expr("o_orderkey % 7 = 3 AS is_deleted"),
    )
    b = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 1000).alias("scope")).distinct().select("scope", F.explode(F.sequence(F.lit(0), F.lit(6), F.lit(2))).alias("k"))
    return b.select("scope", F.concat(F.lit("n"), "k").alias("name"), F.lit("drink").alias("category"), F.lit(1).alias("price")), c


@query(f"WITH RECURSIVE {ORDERED} SELECT scope, seq, name, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN is_new THEN 'added' WHEN is_deleted THEN 'deleted' ELSE 'kept' END AS status, reason FROM g JOIN e USING (scope, seq, name)")
def ups4_ordered_report(spark, sf_dir):
    """UPS4: entries that take and free each other's names, in order."""
    return applied(*ordered_changeset(spark, sf_dir), ["food", "drink"], ["scope"])[1]


@query(f"WITH RECURSIVE {ORDERED} SELECT scope, x.name AS name, x.category AS category, x.price AS price FROM (SELECT scope, unnest(arg_max(held, i)) AS x FROM g GROUP BY scope)")
def ups3_ordered_result(spark, sf_dir):
    """UPS3: what is left of rows that were renamed, deleted and added again."""
    return applied(*ordered_changeset(spark, sf_dir), ["food", "drink"], ["scope"])[0].select("scope", "name", "category", "price")


@query(f"WITH {CHANGES} SELECT printf('%d changed, %d added, %d deleted', count(*) FILTER (status = 'kept'), count(*) FILTER (status = 'added'), count(*) FILTER (status = 'deleted')) AS headline FROM s")
def grd3_report_headline(spark, sf_dir):
    r = applied(*changeset(spark, sf_dir), ["food", "drink"])[1]
    n = lambda s: F.count_if(F.col("status") == s)
    return r.agg(F.format_string("%d changed, %d added, %d deleted", n("kept"), n("added"), n("deleted")).alias("headline"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'no such parent' WHEN p_partkey % 2 = 1 AND p_partkey % 7 = 0 THEN 'no such child' WHEN p_size = 1 THEN 'no name' WHEN p_size = 2 THEN 'price out of range' WHEN p_partkey % 2 = 0 THEN 'already there' WHEN p_size % 2 = 1 THEN 'changes nothing' END AS reason FROM part""")
def ups8_checked_proposals(spark, sf_dir):
    p, k, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    kids = p.select(F.col("p_brand").alias("parent"), F.col("p_name").alias("name"))
    prop = p.select(k.alias("id"), F.when(k % 9 == 0, "nobody").otherwise(F.col("p_brand")).alias("parent"), F.when(k % 7 == 0, "nothing").otherwise(F.col("p_name")).alias("child"), F.when(s == 1, " ").otherwise(F.col("p_name")).alias("name"), F.when(s == 2, 1000.0).otherwise(5.0).alias("price"), (k % 2 == 0).alias("is_add"), F.when(s % 2 == 1, 5.0).otherwise(6.0).alias("was_price"))
    return O.checked(prop, p.select(F.col("p_brand").alias("parent")), kids)
