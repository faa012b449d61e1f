"""Scalars over menu lines of parts, over the lines of all documents, and over the addresses and dates of other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mergestone.functions import classify as C
from mergestone.functions import text as T
from mergestone.functions import vocabulary as V
from mergestone.operators.overlay import lenient_equal
from mergestone.plans.registry import query, table

#: What parts are served with; the rest of a line is the part's own name, brand, size and price.
SERVED = (
    "Almond Crust", "Oat Stout", "Smoked Trout Chowder", "Ginger Beer", "Vegan Dill Sauce", "Pear Perry", "Garlic Toast", "Iced Tea", "Plum Sake", "Water Chestnuts", "Virgin Punch", "Crab Cakes",
    "Onion Soup", "Dry Riesling", "Peach Pie", "Plant-based Bacon", "Gluten-free Bread", "Kimchi Mayo", "Mussels", "Brut Spritz", "Café Cocoa",
)
DISH = "[" + ", ".join(f"'{x}'" for x in SERVED) + f"][CAST(p_size % {len(SERVED)} AS INT) + 1]"
COST = "CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR)"
#: The lines that the queries read: one a part, in nine forms, and all lines of all documents.
SQL = f"""m AS (SELECT 'p' || p_partkey AS id, p_partkey AS n, CASE p_partkey % 9 WHEN 0 THEN p_name || ' and ' || {DISH} || ' (NEW)' WHEN 1 THEN '  ' || p_name || '   ' || p_brand || '  ' WHEN 2 THEN p_size || ' oz ' || {DISH} || ' — $' || {COST} WHEN 3 THEN p_name || ', ' || {DISH} || ', $' || {COST}
WHEN 4 THEN 'NEW! ' || {DISH} WHEN 5 THEN p_name || ' - Opening May ' || p_size WHEN 6 THEN {DISH} || ' 6 oz $' || p_size || '.00 / 12 oz $' || {COST} WHEN 7 THEN p_name || ' Booth (by ' || p_brand || ') presented by ' || p_type || ' 20' || (10 + p_size) ELSE p_name || ' ' || {DISH} || ' Legacy Item (New)' END AS line FROM part
UNION ALL SELECT 'd' || doc_id || '-' || i, i, line FROM (SELECT doc_id, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)))"""
PLAIN = f"translate(lower(line), '{C.ACCENTS[0]}', '{C.ACCENTS[1]}')"


def menu(spark, sf_dir):
    """Rows (id, n, line): menu lines made of the columns of parts, and the lines of documents."""
    c = F.col
    dish = F.element_at(F.array(*map(F.lit, SERVED)), (c("p_size") % len(SERVED) + 1).cast("int"))
    cost, name = c("p_retailprice").cast("decimal(10,2)").cast("string"), c("p_name")
    forms = [
        [name, " and ", dish, " (NEW)"], ["  ", name, "   ", c("p_brand"), "  "], [c("p_size"), " oz ", dish, " — $", cost], [name, ", ", dish, ", $", cost], ["NEW! ", dish], [name, " - Opening May ", c("p_size")],
        [dish, " 6 oz $", c("p_size"), ".00 / 12 oz $", cost], [name, " Booth (by ", c("p_brand"), ") presented by ", c("p_type"), " 20", 10 + c("p_size")], [name, " ", dish, " Legacy Item (New)"],
    ]
    line = F.coalesce(*(F.when(c("p_partkey") % len(forms) == k, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in form))) for k, form in enumerate(forms)))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), c("p_partkey").alias("n"), line.alias("line"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return parts.unionByName(lines.select(F.concat(F.lit("d"), "doc_id", F.lit("-"), "n").alias("id"), c("n").cast("long").alias("n"), "line"))


def matches(pattern, t="t"):
    return f"regexp_matches({t}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def says(out, lists):
    guard = "t"
    for _ in range(2 if out else 0):
        guard = f"regexp_replace({guard}, '{C.any_of(out).replace(chr(39), chr(39) * 2)}', ' ', 'g')"
    return matches(C.any_of(*lists), guard)


NOT_ALC = says((), (V.NOT_ALCOHOLIC_WORDS,))
TAG_SQL = ", ".join(f"CASE WHEN {says(*r)}{' AND NOT ' + NOT_ALC if c == 'contains_alcohol' else ''} THEN '{c}' END" for c, r in C.TAGS.items())


@query(f"WITH {SQL}, t AS (SELECT id, {PLAIN} AS t FROM m) SELECT id, array_to_string(list_filter([{TAG_SQL}], lambda x: x IS NOT NULL), ',') AS tags FROM t")
def cls1_dietary_tags(spark, sf_dir):
    return menu(spark, sf_dir).select("id", F.array_join(C.dietary_tags(F.col("line")), ",").alias("tags"))


@query(f"WITH {SQL}, t AS (SELECT id, {PLAIN} AS t FROM m) SELECT id, array_to_string(list_filter([{', '.join(f'CASE WHEN {says(*r)} THEN {chr(39)}{c}{chr(39)} END' for c, r in C.FLAVOURS.items())}], lambda x: x IS NOT NULL), ',') AS tags FROM t")
def cls2_flavour_tags(spark, sf_dir):
    return menu(spark, sf_dir).select("id", F.array_join(C.flavour_tags(F.col("line")), ",").alias("tags"))


@query(f"WITH {SQL}, t AS (SELECT id, n, {PLAIN} AS t FROM m) SELECT id, CASE WHEN n % 3 <> 0 THEN CASE {' '.join(f'WHEN {says(o, p)} THEN {chr(39)}{k}{chr(39)}' for k, o, p in C.KINDS)} END END AS kind FROM t")
def cls3_alcohol_kind(spark, sf_dir):
    category = F.when(F.col("n") % 3 != 0, "alcoholic_beverage").otherwise("food")
    return menu(spark, sf_dir).select("id", C.alcohol_kind(category, F.col("line")).alias("kind"))


@query(f"""WITH {SQL}, t AS (SELECT id, line, {PLAIN} AS t, CASE WHEN n % 2 = 0 THEN 'food' ELSE 'beverage' END AS section FROM m), a AS (SELECT *, {says(*C.TAGS['contains_alcohol'])} AND NOT {NOT_ALC} AS alc FROM t)
SELECT id, CASE WHEN regexp_matches(line, '(?i)\\(\\s*new\\s*\\)') AND NOT regexp_matches(line, '(?i)\\blegacy item\\b') THEN true END AS is_new, CASE WHEN NOT (section = 'beverage' OR {matches(C.DRINK_AT_END)}) THEN section WHEN alc THEN 'alcoholic_beverage' ELSE 'non_alcoholic_beverage' END AS category, CASE WHEN alc THEN 'alcoholic_beverage' ELSE 'non_alcoholic_beverage' END AS consistent FROM a""")
def cls4_newness_and_category(spark, sf_dir):
    """CLS4, CLS5, CLS6"""
    m = menu(spark, sf_dir).withColumn("tags", C.dietary_tags(F.col("line")))
    section = F.when(F.col("n") % 2 == 0, "food").otherwise("beverage")
    return m.select("id", C.is_new(F.col("line")).alias("is_new"), C.category_of(section, F.col("line"), F.col("tags")).alias("category"), C.consistent_category(F.lit("non_alcoholic_beverage"), F.col("tags")).alias("consistent"))


NORMAL = "lower(strip_accents({x}))"
for pattern in V.LEFT_OUT:
    NORMAL = f"regexp_replace({NORMAL}, '" + pattern.replace("'", "''").replace("{", "{{").replace("}", "}}") + "', ' ', 'g')"
NORMAL = f"trim(regexp_replace({NORMAL}, '\\s+', ' ', 'g'))"


@query(f"WITH {SQL}, k AS (SELECT id, {NORMAL.format(x='line')} AS key FROM m) SELECT id, key, array_to_string(list_sort(string_split(key, ' ')), ' ') AS sorted FROM k")
def str1_normalize_name(spark, sf_dir):
    """STR1, STR2, UDF1"""
    return menu(spark, sf_dir).withColumn("key", T.normalize_name(F.col("line"))).select("id", "key", T.token_sorted(F.col("key")).alias("sorted"))


@query(f"""WITH {SQL} SELECT id, coalesce(nullif(trim(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item') AS slug, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS clean,
regexp_replace(line, '(?i)\\s*[—–-]\\s*[^—–]*\\bopen(?:s|ing)?\\b.*$', '') AS opened, regexp_replace(line, '\\s+\\d{{4}}$', '') AS no_year,
trim(regexp_replace(regexp_replace(regexp_replace(line, '^NEW!?([\\s:]|$)\\s*[:\\-–—]?\\s*', ''), '(?i)\\(\\s*new\\s*\\)', ' ', 'g'), '\\s{{2,}}', ' ', 'g')) AS no_marker FROM m""")
def str4_text_scalars(spark, sf_dir):
    """STR4, STR5, STR6, STR9, STR18"""
    x = F.col("line")
    return menu(spark, sf_dir).select("id", T.slugify(x).alias("slug"), T.clean_text(x).alias("clean"), T.strip_opening(x).alias("opened"), T.strip_year(x).alias("no_year"), T.strip_new_marker(x).alias("no_marker"))


@query(f"""WITH {SQL}, p AS (SELECT id, line, list_transform(regexp_extract_all(line, '\\$\\s*(\\d+(?:\\.\\d{{1,2}})?)', 1), lambda x: CAST(x AS DECIMAL(8,2))) AS ps FROM m) SELECT id, CAST(len(ps) AS INT) AS n, CAST(list_min(ps) AS VARCHAR) AS low, CAST(ps[1] AS VARCHAR) AS first FROM p""")
def mat1_prices(spark, sf_dir):
    """MAT1, AGG15"""
    ps = F.transform(F.regexp_extract_all("line", F.lit(r"\$\s*(\d+(?:\.\d{1,2})?)"), F.lit(1)), T.price_of)
    return menu(spark, sf_dir).withColumn("ps", ps).select("id", F.size("ps").alias("n"), F.array_min("ps")["text"].alias("low"), F.try_element_at("ps", F.lit(1))["text"].alias("first"))


@query(rf"""WITH {SQL}, c AS (SELECT id, line, regexp_replace(line, '^((?s:.*))(?:\s+[—–-]\s+|,\s+)[^$]*\$.*$', '\1') AS cut FROM m),
n AS (SELECT id, line, regexp_replace(regexp_replace(cut, '\s*\$\s*\d+(?:\.\d{{1,2}})?\s*$', ''), '[\s,—–-]+$', '') AS cut FROM c), f AS (SELECT *, CASE WHEN cut = '' THEN line ELSE cut END AS name, regexp_extract(line, '^(\S+\s+\S+)', 1) AS start FROM n),
d AS (SELECT id, name, trim(regexp_replace(regexp_replace(CASE WHEN starts_with(line, start) THEN line[length(start) + 1:] ELSE line END, '^[\s:,—–-]+', ''), '[\s,—–-]*\$\s*\d+(?:\.\d{{1,2}})?\s*$', '')) AS text FROM f)
SELECT id, name, CASE WHEN text = '' OR contains(text, '$') OR NOT regexp_matches(text, '[A-Za-z]') THEN NULL ELSE text END AS description FROM d""")
def str7_price_clause_and_description(spark, sf_dir):
    """STR7, STR8"""
    x = F.col("line")
    return menu(spark, sf_dir).withColumn("name", T.strip_price_clause(x)).select("id", "name", T.description_of(x, F.regexp_extract(x, r"^(\S+\s+\S+)", 1)).alias("description"))


BARE = "regexp_replace(url, '[#?].*$', '')"


@query(rf"""WITH u AS (SELECT page_id, replace(url, '/en/', '/' || (2000 + page_id % 60) || '/') AS url FROM pages) SELECT page_id, {BARE} AS absolute, regexp_replace(split_part(url, '/', 3), '^www\.', '') AS host, {BARE} AS same,
CASE WHEN regexp_matches({BARE}, '/20\d\d/') THEN 'permalink' WHEN regexp_matches({BARE}, '\.html?$') THEN 'article' WHEN regexp_matches({BARE}, '/\d+$') THEN 'item' ELSE 'hub' END AS kind,
CASE WHEN contains({BARE}, '/20') THEN TRY_CAST(list_filter(string_split({BARE}, '/')[4:], lambda x: regexp_full_match(x, '20\d\d'))[1] AS INT) END AS year, url AS original, '.jpg' AS ext FROM u""")
def str11_url_scalars(spark, sf_dir):
    """STR11, STR12, STR13, STR14, STR17; pages in English stand under a year."""
    p = table(spark, sf_dir, "pages").select("page_id", F.replace("url", F.lit("/en/"), F.concat(F.lit("/"), (2000 + F.col("page_id") % 60).cast("string"), F.lit("/"))).alias("url"))
    u = F.col("url")
    archived = F.concat(F.lit("https://web.example/web/2020id_/"), u)
    same = T.absolute_url(F.regexp_replace(u, "^https?:", ""), "x")
    scheme = F.regexp_extract(u, "^https?", 0)
    return p.select("page_id", T.absolute_url(u, "example.org").alias("absolute"), T.host_key(u).alias("host"), F.regexp_replace(same, "^https", scheme).alias("same"), T.page_kind(u).alias("kind"), T.url_year(F.regexp_replace(u, "[#?].*$", "")).alias("year"), T.archive_original(archived).alias("original"), T.extension_of(u).alias("ext"))


@query("""WITH w AS (SELECT p_partkey AS id, p_size, string_split(p_name, ' ') AS w FROM part) SELECT id, CASE WHEN p_size % 3 < 2 THEN array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), ' ') WHEN p_size % 3 = 2 AND id % 5 = 0 THEN array_to_string(list_transform(w[-1:], lambda x: upper(x[1]) || lower(x[2:])), ' ') END AS name FROM w""")
def str15_name_from_file(spark, sf_dir):
    """STR15 over the names of parts: behind a year and a size, behind noise, without the word, and with a year between."""
    k, s, stem = F.col("p_partkey"), F.col("p_size"), F.replace("p_name", F.lit(" "), F.lit("-"))
    words = F.split("p_name", " ")
    between = F.concat_ws("-", F.slice(words, 1, F.size(words) - 1), F.lit("2019"), F.element_at(words, -1), F.lit("booth.JPG"))
    file = F.when(s % 3 == 0, F.concat(F.lit("2019-"), stem, F.lit("-booth-300x200.jpg"))).when(s % 3 == 1, F.concat(F.lit("festival-"), stem, F.lit("-booth.png"))).when(k % 5 == 0, between).otherwise(F.concat(stem, F.lit(".jpg")))
    return table(spark, sf_dir, "part").select(k.alias("id"), T.name_from_file(file).alias("name"))


@query("""SELECT o_orderkey AS id, CAST(year(o_orderdate) + CAST(month(o_orderdate) >= 12 AS INT) AS INT) AS season, strftime(o_orderdate, '%b') || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) AS shown, CAST(o_orderdate AS DATE) AS from_text, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS from_url FROM orders""")
def dat2_dates(spark, sf_dir):
    """DAT2, DAT3, DAT4, DAT5: seasons, dates out of sentences and addresses (impossible ones dropped), dates for display."""
    d = F.to_date("o_orderdate")
    sentence = F.concat(F.lit("from "), F.date_format(d, "MMMM d"), F.lit(" to December 31, "), F.date_format(d, "yyyy"))
    text = F.try_to_date(F.concat_ws(" ", F.regexp_extract(sentence, r"from (\w+ \d+) to", 1), F.regexp_extract(sentence, r", (\d{4})", 1)), "MMMM d yyyy")
    url = F.concat(F.lit("/news/"), F.when(F.col("o_orderkey") % 7 == 0, "31feb2020").otherwise(F.lower(F.date_format(d, "ddMMMyyyy"))), F.lit("-x"))
    part = F.regexp_extract(url, r"/news/(\d{2}[a-z]{3}\d{4})-", 1)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.year(d) + (F.month(d) >= 12).cast("int")).alias("season"), F.coalesce(F.date_format(d, "MMM d, yyyy"), F.lit("date TBC")).alias("shown"), text.alias("from_text"), F.try_to_date(F.concat(F.substring(part, 1, 2), F.initcap(F.substring(part, 3, 3)), F.substring(part, 6, 4)), "ddMMMyyyy").alias("from_url"))


@query("""SELECT l_orderkey, l_linenumber, abs(l_extendedprice - l_quantity * 1000) / abs(l_quantity * 1000) > 0.2 AS far, abs(l_discount - l_tax) < 1e-6 AS same_place, CAST(CAST(l_quantity AS INT) AS VARCHAR) = CAST(l_linenumber AS VARCHAR) AS equal, l_extendedprice < l_quantity * 1000 AS below FROM lineitem""")
def mat2_comparisons(spark, sf_dir):
    """MAT2, MAT4, MAT6"""
    q = F.col("l_quantity") * 1000
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.abs(F.col("l_extendedprice") - q) / F.abs(q) > 0.2).alias("far"), (F.abs(F.col("l_discount") - F.col("l_tax")) < 1e-6).alias("same_place"), lenient_equal(F.col("l_quantity").cast("int").cast("string"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".0"))).alias("equal"), (F.col("l_extendedprice") < q).alias("below"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS DECIMAL(10,2)) * 2 AS twice, json_extract_string(props, '$.none') AS missing FROM events""")
def jsn1_json_lookup(spark, sf_dir):
    """JSN1, JSN2: paths and types out of JSON text."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.try_cast("int").alias("k"), (k.try_cast("decimal(10,2)") * 2).cast("decimal(18,2)").alias("twice"), F.get_json_object("props", "$.none").alias("missing"))


@query(r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS content_hash FROM pages""")
def hsh1_content_hash(spark, sf_dir):
    """HSH1, EXT0: a page's hash does not change with its markup or white space."""
    t = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)\s*>", " "), r"(?s)<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.trim(F.regexp_replace(t, r"\s+", " ")), 256).alias("content_hash"))


@query("""SELECT doc_id, len(list_distinct(string_split(lower(text), ' '))) AS n_words, list_contains(string_split(lower(text), ' '), 'the') AS has_the FROM documents""")
def arr1_word_arrays(spark, sf_dir):
    w = F.split(F.lower("text"), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(w)).cast("long").alias("n_words"), F.array_contains(w, "the").alias("has_the"))


@query(f"""WITH t AS (SELECT doc_id, translate(lower(coalesce(text, '')), '{C.ACCENTS[0]}', '{C.ACCENTS[1]}') AS t FROM documents) SELECT doc_id, array_to_string(list_filter([{TAG_SQL}], lambda x: x IS NOT NULL), ',') AS tags FROM t""")
def cls1_dietary_tags_of_documents(spark, sf_dir):
    """CLS1 over long, mostly negative texts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(C.dietary_tags(F.col("text")), ",").alias("tags"))
