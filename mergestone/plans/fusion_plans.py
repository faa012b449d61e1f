"""Fusion and triage over lineitem: a part is an entity, a supplier a source, a line an observation of the part's unit price."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergestone.operators import fusion as U
from mergestone.operators import triage as T
from mergestone.plans.registry import query, table

OBS = """obs AS (SELECT l_partkey AS entity, CAST(year(l_shipdate) AS VARCHAR) AS field, l_suppkey AS source,
  CASE WHEN l_suppkey % 50 = 0 THEN 0 ELSE 1 + l_suppkey % 7 END AS rank, l_shipdate AS observed_at, l_orderkey * 10 + l_linenumber AS ref,
  CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT) AS value, l_returnflag AS flag FROM lineitem)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("entity"), F.year("l_shipdate").cast("string").alias("field"), F.col("l_suppkey").alias("source"),
        F.when(F.col("l_suppkey") % 50 == 0, 0).otherwise(1 + F.col("l_suppkey") % 7).alias("rank"), F.col("l_shipdate").alias("observed_at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long").alias("value"), F.col("l_returnflag").alias("flag"),
    )


WINNER = "row_number() OVER (PARTITION BY entity, field ORDER BY rank, observed_at DESC, ref, source DESC, value DESC)"


@query(f"WITH {OBS} SELECT entity, field, value, ref, source, CAST(rank AS INT) AS rank, n FROM (SELECT *, count(*) OVER (PARTITION BY entity, field) AS n, {WINNER} AS k FROM obs) WHERE k = 1")
def fus3_priority_fusion(spark, sf_dir):
    """FUS3, WIN5"""
    return U.fused(observations(spark, sf_dir), U.by_priority()).withColumn("rank", F.col("rank").cast("int"))


@query(f"WITH {OBS} SELECT entity, field, value, ref, source, n FROM (SELECT *, count(*) OVER (PARTITION BY entity, field) AS n, row_number() OVER (PARTITION BY entity, field ORDER BY observed_at DESC, ref, source DESC, value DESC) AS k FROM obs) WHERE k = 1")
def win6_most_recent_fusion(spark, sf_dir):
    return U.fused(observations(spark, sf_dir), U.by_recency()).drop("rank")


@query(f"WITH {OBS} SELECT entity, field, source, ref, value FROM (SELECT *, row_number() OVER (PARTITION BY entity, field, source, ref ORDER BY observed_at) AS k FROM obs) WHERE k = 1")
def fus2_distinct_candidates(spark, sf_dir):
    o = observations(spark, sf_dir)
    return U.distinct_candidates(o.unionByName(o)).select("entity", "field", "source", "ref", "value")


@query(f"WITH {OBS}, w AS (SELECT *, {WINNER} AS k FROM obs) SELECT entity, field, source, ref, value, k = 1 AS is_selected FROM w")
def fus5_selected_candidates(spark, sf_dir):
    o = observations(spark, sf_dir)
    return U.selected(o, U.by_priority()).select("entity", "field", "source", "ref", "value", "is_selected")


DISAGREE = f"""{OBS}, w AS (SELECT *, {WINNER} AS k FROM obs), win AS (SELECT entity, field, value AS w FROM w WHERE k = 1),
d AS (SELECT entity, field, count(*) AS n_values, count(*) >= 2 AND bool_or(CASE WHEN w = 0 THEN value <> 0 ELSE abs(value - w) > 0.2 * abs(w) END) AS disagrees FROM obs JOIN win USING (entity, field) GROUP BY entity, field)"""


@query(f"WITH {DISAGREE} SELECT * FROM d")
def fus6_numeric_disagreement(spark, sf_dir):
    o = observations(spark, sf_dir)
    return U.disagreement(o, U.by_priority(), numeric=True)


@query(f"WITH {OBS} SELECT entity, field, count(*) AS n_values, count(*) >= 2 AND count(DISTINCT flag) > 1 AS disagrees FROM obs GROUP BY entity, field")
def fus6_text_disagreement(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("value", F.col("flag"))
    return U.disagreement(o, U.by_priority(), numeric=False)


@query(f"""WITH {DISAGREE}, opened AS (SELECT DISTINCT entity, field FROM obs WHERE entity % 3 = 0)
SELECT entity, field, CASE WHEN coalesce(disagrees, false) AND o.e IS NOT NULL THEN 'updated' WHEN disagrees THEN 'opened' WHEN o.e IS NOT NULL THEN 'resolved' ELSE 'unchanged' END AS action
FROM d LEFT JOIN (SELECT entity AS e, field AS f FROM opened) o ON entity = e AND field = f""")
def fus7_conflict_lifecycle(spark, sf_dir):
    o = observations(spark, sf_dir)
    return U.conflict_changes(U.disagreement(o, U.by_priority(), numeric=True), o.filter("entity % 3 = 0"))


@query(f"""WITH {OBS}, m AS (SELECT entity, field, flag AS member, min(rank * 10000000000 + ref) AS first FROM obs GROUP BY ALL),
u AS (SELECT entity, field, string_agg(member, ',' ORDER BY first) AS v FROM m GROUP BY ALL),
c AS (SELECT entity, field, flag FROM (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY observed_at DESC, ref, source DESC, flag DESC) AS k FROM obs WHERE rank = 0) WHERE k = 1)
SELECT entity, field, coalesce(c.flag, u.v) AS value, c.flag IS NOT NULL AS is_curated FROM u LEFT JOIN c USING (entity, field)""")
def fus4_union_with_curated_replacement(spark, sf_dir):
    """FUS4, AGG12"""
    o = observations(spark, sf_dir).withColumn("value", F.array("flag"))
    return U.union_fused(o).withColumn("value", F.array_join("value", ","))


@query(f"""WITH {OBS}, l AS (SELECT entity, source, value, row_number() OVER (PARTITION BY entity, source ORDER BY observed_at DESC, ref DESC) AS k FROM obs)
SELECT entity, count(*) AS n_sources, string_agg(source || '=' || value, ';' ORDER BY source) AS values FROM l WHERE k = 1 GROUP BY entity""")
def agg11_values_by_source(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("field", F.lit("price"))
    m = U.by_source(o)
    return m.select("entity", F.size("values").cast("long").alias("n_sources"), F.array_join(F.transform(F.map_entries("values"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ";").alias("values"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS record, f AS field, v AS value FROM lineitem, LATERAL (VALUES ('price', CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_extendedprice AS VARCHAR) END), ('flag', l_returnflag)) t(f, v)
WHERE v IS NOT NULL OR l_suppkey % 50 = 0""".replace("CAST(l_extendedprice AS VARCHAR)", "l_linestatus"))
def fus1_wide_to_long(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    payload = F.create_map(F.lit("p"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linestatus")), F.lit("f"), F.col("l_returnflag"))
    records = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record"), F.when(F.col("l_suppkey") % 50 == 0, 0).otherwise(1).alias("rank"), payload.alias("payload"))
    return U.long_candidates(records, {"p": "price", "f": "flag", "x": "never"}, ["record"])


@query(f"""WITH {OBS}, w AS (SELECT *, {WINNER} AS k FROM obs) SELECT w.entity, w.field, s.s_name AS source_key, w.rank = 0 AS curated, w.ref, w.value, k = 1 AS is_selected FROM w JOIN supplier s ON s.s_suppkey = w.source WHERE w.entity % 10 = 1""")
def pub5_provenance_view(spark, sf_dir):
    o = observations(spark, sf_dir).filter("entity % 10 = 1")  # the view of some entities is the feature
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_name").alias("source_key"))
    return U.selected(o, U.by_priority()).join(s, "source").select("entity", "field", "source_key", (F.col("rank") == 0).alias("curated"), "ref", "value", "is_selected")


# ------------------------------------------------------------------------------------------------------------- triage

LAST = f"{OBS}, c AS (SELECT entity * 10000 + CAST(field AS INT) AS id, rank, source, value FROM (SELECT *, row_number() OVER (PARTITION BY entity, field, source ORDER BY observed_at DESC, ref DESC) AS k FROM obs) WHERE k = 1)"


def conflicts(spark, sf_dir):
    o = observations(spark, sf_dir)
    last = o.groupBy("entity", "field", "source").agg(F.max_by(F.struct("rank", "value", "flag"), F.struct("observed_at", "ref")).alias("c"))
    return last.select((F.col("entity") * 10000 + F.col("field").cast("int")).alias("id"), "source", "c.*")


@query(f"""WITH {LAST}, m AS (SELECT id, median(value) AS m, count(*) AS n FROM c GROUP BY id), g AS (SELECT id, max(n) AS n, count(*) FILTER (abs(value - m) <= 0.2 * abs(m)) AS agree,
arg_min(value, rank * 100000000000 + value) FILTER (abs(value - m) <= 0.2 * abs(m)) AS best FROM c JOIN m USING (id) GROUP BY id)
SELECT id, n, agree, CASE WHEN n >= 2 AND agree > n - agree AND n > agree THEN best END AS proposal, CASE WHEN n >= 2 AND agree > n - agree AND n > agree THEN CAST(0.9 AS DOUBLE) END AS confidence FROM g""")
def tri1_numeric_outliers(spark, sf_dir):
    """TRI1, AGG14"""
    return T.numeric_outliers(conflicts(spark, sf_dir))


@query("""WITH c AS (SELECT p_size AS id, p_partkey % 5 AS rank, p_name AS value, p_brand AS b, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_type || ' ' || p_brand END AS key FROM part),
g AS (SELECT id, arg_min(value, (rank, value)) AS best, max(length(key)) AS ml, count(DISTINCT key) AS nk, count(*) AS n FROM c GROUP BY id),
l AS (SELECT id, key, value, row_number() OVER (PARTITION BY id ORDER BY length(key) DESC, rank, value, key) AS k FROM c),
h AS (SELECT c.id, bool_and(contains(l.key, c.key)) AS holds FROM c JOIN l ON l.id = c.id AND l.k = 1 GROUP BY c.id)
SELECT id, CASE WHEN n >= 2 AND nk = 1 THEN 'same' WHEN n >= 2 AND holds THEN 'whole' ELSE 'person' END AS verdict FROM g JOIN h USING (id)""")
def tri2_text_variants(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).otherwise(F.concat_ws(" ", "p_type", "p_brand"))
    c = p.select(F.col("p_size").alias("id"), (F.col("p_partkey") % 5).alias("rank"), F.col("p_name").alias("value"), key.alias("key"))
    out = T.text_variants(c)
    return out.select("id", F.when(F.col("confidence") == 0.95, "same").when(F.col("confidence") == 0.7, "whole").otherwise("person").alias("verdict"))


@query("""SELECT o_orderkey AS id, CASE WHEN 70 + o_orderkey % 20 >= 80 THEN 'match' ELSE 'new_entity' END AS proposal, round(least(0.5 + 0.3 * abs(70 + o_orderkey % 20 - 80.0) / 10, 0.8), 6) AS confidence FROM orders""")
def tri3_score_band(spark, sf_dir):
    proposal, confidence = T.score_band((70 + F.col("o_orderkey") % 20).cast("double"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), proposal.alias("proposal"), F.round(confidence, 6).alias("confidence"))


@query("""WITH s AS (SELECT l_orderkey AS id, l_partkey AS parent, max(CAST(l_quantity * 2 AS INT)) AS score FROM lineitem GROUP BY ALL), t AS (SELECT id, parent, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, parent) AS k FROM s),
b AS (SELECT a.id, a.parent, CAST(a.score AS DOUBLE) AS score, CAST(a.score - coalesce(c.score, 0) AS DOUBLE) AS gap FROM t a LEFT JOIN t c ON c.id = a.id AND c.k = 2 WHERE a.k = 1)
SELECT id, score, gap, CASE WHEN score >= 75 AND gap >= 15 THEN parent END AS parent, CASE WHEN score >= 75 AND gap >= 15 THEN round(least(0.5 + (score - 75) / 50, 0.8), 6) END AS confidence FROM b""")
def tri4_parent_reference(spark, sf_dir):
    """TRI4, WIN8"""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("parent")).agg(F.max((F.col("l_quantity") * 2).cast("int")).cast("double").alias("score"))
    return T.parent_reference(s).withColumn("confidence", F.round("confidence", 6))


@query("""SELECT status, kind, count(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'field_value' WHEN 1 THEN 'ambiguous_match' ELSE 'missing_parent' END AS kind,
CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 11 >= 9 THEN 'resolved' WHEN o_orderkey % 11 >= 4 THEN 'suggested' ELSE 'open' END AS status FROM orders) GROUP BY ALL""")
def tri5_dispatch(spark, sf_dir):
    """TRI5, CLS7"""
    from mergestone.functions.classify import conflict_kind

    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(conflict_kind(F.when(k % 3 == 0, F.lit("price")), F.when(k % 3 == 1, k)).alias("kind"), F.when(k % 11 >= 9, 0.9).when(k % 11 >= 4, 0.7).alias("confidence"))
    return T.dispatched(rows).groupBy("status", "kind").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 3 = 0 THEN 'resolved' WHEN o_orderkey % 4 = 0 AND o_custkey % 3 = 1 THEN 'dismissed' WHEN o_orderkey % 4 = 0 THEN 'suggested' ELSE 'open' END AS status FROM orders""")
def tri6_decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "suggested").otherwise("open").alias("status"))
    d = o.filter("o_custkey % 3 < 2").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 == 0, "accept").otherwise("reject").alias("decision"))
    return T.decided(c, d)


@query(f"""WITH {LAST}, m AS (SELECT id, median(value) AS m, count(*) AS n FROM c GROUP BY id), g AS (SELECT id, max(n) AS n, count(*) FILTER (abs(value - m) <= 0.2 * abs(m)) AS agree,
arg_min(value, rank * 100000000000 + value) FILTER (abs(value - m) <= 0.2 * abs(m)) AS best, min(value) AS low FROM c JOIN m USING (id) GROUP BY id)
SELECT id, CAST(CASE WHEN n >= 2 AND agree > n - agree AND n > agree THEN best ELSE low END AS VARCHAR) AS proposal, CASE WHEN n >= 2 AND agree > n - agree AND n > agree THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS confidence FROM g""")
def udf6_pluggable_resolvers(spark, sf_dir):
    lowest = lambda c: c.groupBy("id").agg(F.min("value").alias("proposal")).withColumn("confidence", F.lit(0.4))
    return T.proposed_by(conflicts(spark, sf_dir), [T.numeric_outliers, lowest])
