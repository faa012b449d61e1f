"""Extraction from the driver's pages. Every query parses the whole html of each page. What the pages lack, such as prices, labels
and images, is written into their own markup, next to their own words: each list item gets a price, the headline a caption."""

from __future__ import annotations

from pyspark.sql import functions as F

from mergestone.operators import elements as E
from mergestone.plans.registry import query, table


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


#: A page's headline as a reader sees it, its list items, and the headline as it stands in the markup. The parser reads a character
#: reference with or without its semicolon, so also one that the end of the headline cuts off behind its name; one cut off inside its digits names a
#: control character, which no text holds. White space is what the parser's text is split at.
TITLE = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"
for said, shown in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#x27(?:;|([^0-9A-Fa-f;])|$)", r"''\1"), ("&#x2$", ""), ("&amp;?", "&")):
    TITLE = f"regexp_replace({TITLE}, '{said}', '{shown}', 'g')"
TITLE = rf"trim(regexp_replace({TITLE}, '[\s\x0B\x1C-\x1F\x{{85}}\pZ]+', ' ', 'g'))"
ITEM = "unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1))"
HEAD = "<h1>([^<]*)</h1>"


def menus(spark, sf_dir):
    """Each page with its list as a menu of food under its headline, prices on the list's items, captioned images behind the
    headline, and a second list behind its end."""
    k, head = F.col("page_id"), F.regexp_extract("html", HEAD, 1)
    html = F.regexp_replace("html", F.lit("</a></li>"), F.concat(F.lit(r" - \$"), (k % 9 + 1).cast("string"), F.lit(r".50 / large \$99</a></li>")))
    image = F.concat(F.lit("<img src='/a"), k % 7, F.lit(".jpg'"))
    html = F.regexp_replace(html, F.lit(HEAD), F.concat(F.lit("<h1>$1</h1>"), image, F.lit(" width='300'><figcaption>$1</figcaption>"), image, F.lit("><figcaption>Again</figcaption><img src='/tiny.jpg' width='20'><figcaption>Small one</figcaption>")))
    html = F.concat(F.lit("<h3>"), head, F.lit("</h3><p>Food:</p>"), html, F.lit("<p>Beverages</p><ul><li>Ale</li><li>Ale</li></ul><h3>Next</h3><p>No price here</p>"))
    return pages(spark, sf_dir).select("page_id", html.alias("html"))


@query(f"""SELECT page_id, trim(name) AS name, CAST(page_id % 9 + 1 AS VARCHAR) || '.50' AS price FROM (SELECT page_id, {ITEM} AS name FROM pages)""")
def ext1_priced_items(spark, sf_dir):
    """EXT1, WIN10, AGG15, UDF3"""
    return E.priced_items(E.tokenised(menus(spark, sf_dir))).select("page_id", "name", "price")


@query(f"""SELECT page_id, 'food' AS category, count(*) AS n, max(t) AS parent FROM (SELECT page_id, {TITLE} AS t, {ITEM} AS name FROM pages) GROUP BY 1 UNION ALL SELECT page_id, 'beverage', 2, {TITLE} FROM pages""")
def ext2_labelled_sections(spark, sf_dir):
    """EXT2, EXT9, UDF5"""
    e = E.tokenised(menus(spark, sf_dir))
    items = E.labelled_items(e, {"food": "food", "beverages": "beverage"}, F.col("tag") == "h3", F.col("text"))
    return items.groupBy("page_id", "category").agg(F.count("*").alias("n"), F.max("parent").alias("parent"))


@query(f"""WITH i AS (SELECT page_id, {ITEM} || ' - $' || (page_id % 9 + 1) || '.50 / large $99' AS name FROM pages UNION ALL SELECT page_id, 'Ale' FROM pages, generate_series(1, 2))
SELECT page_id, CASE WHEN count(*) OVER (PARTITION BY page_id, name[1:2]) > 1 THEN name ELSE name[1:2] END AS shown FROM i""")
def agg5_restored_long_names(spark, sf_dir):
    """AGG5: the first letters of an item stand for it where no other item of its section begins with them."""
    items = E.labelled_items(E.tokenised(menus(spark, sf_dir)), {"food": "food", "beverages": "beverage"}, F.col("tag") == "h3", F.col("text"))
    return E.restored_names(items.withColumn("short", F.substring("name", 1, 2)), "short", "name").select("page_id", "shown")


@query(f"""SELECT page_id, '/a' || page_id % 7 || '.jpg' AS src, caption FROM (SELECT page_id, {TITLE} AS caption FROM pages) WHERE length(caption) BETWEEN 3 AND 160 AND NOT regexp_matches(caption, '(?i)\\blogo\\b|\\bsponsor')""")
def ext5_captioned_images(spark, sf_dir):
    """EXT5, WIN9, WIN11"""
    return E.captioned_images(E.tokenised(menus(spark, sf_dir)), r"(?i)\blogo\b|\bsponsor").select("page_id", "src", "caption")


@query("""SELECT page_id, CASE WHEN len(list_filter(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1), lambda x: regexp_matches(x, '^[A-Z]'))) > 0 THEN 'boundary' ELSE 'headings' END AS layout FROM pages""")
def ext4_layout_dispatch(spark, sf_dir):
    """EXT4: here the boundaries are list items that begin with a capital letter."""
    return E.layout(E.tokenised(pages(spark, sf_dir)), (F.col("tag") == "li") & F.col("text").rlike("^[A-Z]"))


@query("""WITH v AS (SELECT conv_id AS page_id, role AS name, count(*) AS n FROM conversations GROUP BY ALL), t AS (SELECT page_id, sum(n) AS a FROM v GROUP BY 1) SELECT page_id, name, n AS votes FROM v JOIN t USING (page_id) WHERE n >= 2 AND n > 0.5 * a""")
def agg4_majority_vote(spark, sf_dir):
    return E.majority(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("role").alias("name")))


@query(r"""SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) WHERE regexp_matches(href, '^/[a-z]')""")
def src6_link_discovery(spark, sf_dir):
    return E.links(E.tokenised(pages(spark, sf_dir)), "^/[a-z]").select("page_id", "href")


@query("""WITH l AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked, first_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS answered FROM conversations) SELECT conv_id, turn, asked, answered FROM l""")
def win10_carried_turns(spark, sf_dir):
    """WIN10, WIN11 over turns of conversations."""
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "page_id").withColumnRenamed("turn", "pos")
    c = E.carried(c, F.when(F.col("role") == "user", F.col("pos")), "asked")
    return E.carried(c, F.when(F.col("role") == "assistant", F.col("pos")), "answered", back=True).select(F.col("page_id").alias("conv_id"), F.col("pos").alias("turn"), "asked", "answered")


@query("""SELECT page_id, count(*) AS n, max(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS name, max(page_id) AS b FROM pages, generate_series(1, 3) GROUP BY 1""")
def jsn3_json_ld(spark, sf_dir):
    """JSN3 in whole pages, among their other scripts: an object with the page's headline, a list of two, and one that is broken."""
    k = F.col("page_id")
    own = F.to_json(F.struct(k.alias("id"), F.regexp_extract("html", HEAD, 1).alias("name")))
    kind = F.lit('<script type="application/ld+json">')
    html = F.concat(kind, own, F.lit("</script>"), "html", kind, F.lit('[{"a": 1}, {"b": '), k, F.lit("}]</script>"), kind, F.lit("{broken</script>"))
    found = E.json_ld(pages(spark, sf_dir).select("page_id", html.alias("html")))
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.max(F.get_json_object("value", "$.name")).alias("name"), F.max(F.get_json_object("value", "$.b").cast("long")).alias("b"))


@query(r"""SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS site, CAST(DATE '2026-01-01' + CAST(page_id % 150 AS INT) AS DATE) AS start, CAST(DATE '2026-01-01' + CAST(page_id % 150 + page_id % 90 AS INT) AS DATE) AS until FROM pages""")
def ext7_overview_records(spark, sf_dir):
    """EXT7, DAT3: the dates of a season out of the first paragraph of a page that names any."""
    k = F.col("page_id")
    day = lambda n: F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), n.cast("int")), "MMMM d")
    html = F.regexp_replace("html", F.lit("(?s)^(.*?)<p>"), F.concat(F.lit("$1<p>Open from "), day(k % 150), F.lit(" to "), day(k % 150 + k % 90), F.lit(", 2026. ")))
    e = E.tokenised(pages(spark, sf_dir).select("page_id", html.alias("html"))).filter("tag = 'p'")
    said = r"from (\w+ \d+) to (\w+ \d+), (\d{4})"
    first = e.filter(F.col("text").rlike(said)).groupBy("page_id").agg(F.min_by("text", "pos").alias("text"))
    d = lambda g: F.try_to_date(F.concat_ws(" ", F.regexp_extract("text", said, g), F.regexp_extract("text", said, 3)), "MMMM d yyyy")
    return pages(spark, sf_dir).select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("site")).join(first, "page_id").select("page_id", "site", d(1).alias("start"), d(2).alias("until"))


def boundaries(spark, sf_dir):
    """Each page with boundary paragraphs: its headline before its own list of food, and two more behind its end."""
    html = F.concat(F.lit("<p class='boundary'>"), F.regexp_extract("html", HEAD, 1), F.lit("</p><p>Food:</p>"), "html", F.lit("<p class='boundary'>Well</p><p>no label</p><ul><li>Stone</li></ul><p class='boundary'>Inn</p><p>Beverages:</p><ul><li>Ale</li></ul>"))
    return pages(spark, sf_dir).select("page_id", html.alias("html"))


def boundary_items(pages_df):
    edge = (F.col("tag") == "p") & F.coalesce(F.col("class") == "boundary", F.lit(False))
    return E.labelled_items(E.tokenised(pages_df), {"food": "food", "beverages": "beverage"}, edge, F.col("text"))


@query(f"SELECT page_id, {TITLE} AS parent, 'food' AS category, {ITEM} AS name FROM pages UNION ALL SELECT page_id, 'Inn', 'beverage', 'Ale' FROM pages")
def ext3_boundary_sections(spark, sf_dir):
    """EXT3, UDF5: a section without a label gives no items."""
    return boundary_items(boundaries(spark, sf_dir)).select("page_id", "parent", "category", "name")


@query(f"SELECT page_id, 'a' || page_id % 7 AS parent, name, '/a' || page_id % 7 || '.jpg' AS image FROM (SELECT page_id, {TITLE} AS name FROM pages) WHERE page_id % 3 <> 0 AND length(name) BETWEEN 3 AND 160 AND NOT regexp_matches(name, '(?i)\\blogo\\b')")
def ext6_caption_records(spark, sf_dir):
    """EXT6, AGG4: captions become attach-only records of the parent that most image names of a page vote for; without one, none."""
    k = F.col("page_id")
    m = menus(spark, sf_dir).withColumn("html", F.when(k % 3 == 0, F.concat("html", F.lit("<img src='/b.jpg'><figcaption>Other</figcaption>"))).otherwise(F.concat("html", F.lit("<img src='/x/a"), k % 7, F.lit(".png'>"))))
    e = E.tokenised(m)
    votes = e.filter("tag = 'img' and src not like '%tiny%'").select("page_id", F.regexp_extract("src", r"([a-z]\d*)\.[a-z]+$", 1).alias("name"))
    won = E.majority(votes, least=3, share=0.7).select("page_id", F.col("name").alias("parent"))
    c = E.captioned_images(e, r"(?i)\blogo\b").select("page_id", F.col("caption").alias("name"), F.col("src").alias("image"))
    return c.join(won, "page_id").select("page_id", "parent", "name", "image")


@query(f"SELECT page_id, n || '$2' AS old_name, n AS new_name FROM (SELECT page_id, {ITEM} AS n FROM pages UNION ALL SELECT page_id, 'Ale' FROM pages)")
def ext10_reparse(spark, sf_dir):
    """EXT10, JOI13: stored pages are extracted anew, and each new record takes the link of the old one at its place."""
    from mergestone.operators.versions import positional_pairs

    new = boundary_items(boundaries(spark, sf_dir)).withColumn("kind", F.lit("menu_item"))
    old = new.withColumn("name", F.concat("name", F.lit("$2")))  # what the earlier parse had left on
    pick = lambda df: df.select(F.col("page_id").alias("page"), "kind", F.struct("pos", "name").alias("record"))
    return positional_pairs(pick(old), pick(new)).select(F.col("page").alias("page_id"), F.col("old_record.name").alias("old_name"), F.col("new_record.name").alias("new_name"))
