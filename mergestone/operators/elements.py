"""Pages to element rows, and logic over them in windows by page."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergestone.functions.text import price_of

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
KEPT = frozenset("h1 h2 h3 h4 h5 h6 p li a img figcaption figure strong title footer nav article div span td".split())
SCHEMA = "page_id long, pos int, tag string, level int, parent_tag string, class string, text string, href string, src string, alt string, width int, height int"


#: Rows, and letters of their texts, in a batch that goes back to Spark.
ROWS, LETTERS = 2_000, 4_000_000


class _Elements(HTMLParser):
    """``rows``: elements as they stand in SCHEMA, with the range of their pieces of ``data`` in place of a text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.data: list[str] = []
        self.stack: list[tuple[str, int | None]] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
            return
        if tag in ("p", "li") and self.stack and any(t == tag for t, _ in self.stack):
            self.handle_endtag(tag)
        a = dict(attrs)
        at = None
        if tag in KEPT:
            number = lambda k: int(a[k]) if (a.get(k) or "").isdigit() and len(a[k]) < 9 else None
            at = len(self.rows)
            begins = len(self.data)
            self.rows.append([at, tag, len(self.stack), self.stack[-1][0] if self.stack else None, a.get("class"), (begins, begins if tag in VOID else None), a.get("href"), a.get("src"), a.get("alt"), number("width"), number("height")])
        if tag not in VOID:
            self.stack.append((tag, at))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                for _, at in self.stack[k:]:
                    if at is not None:
                        self.rows[at][5] = (self.rows[at][5][0], len(self.data))
                del self.stack[k:]
                return

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.data.append(data)

    def elements(self) -> Iterator[list]:
        for r in self.rows:
            begins, ends = r[5]
            yield [*r[:5], " ".join("".join(self.data[begins:ends]).split()), *r[6:]]


def tokenised(pages: DataFrame) -> DataFrame:
    """UDF3: one row for each element of interest of (page_id, html), in document order, its text including what is inside it.
    Pages are independent rows, which the standard library parses one by one. Rows go back to Spark in small batches, so a task holds one
    page and one batch of rows, however many pages it has."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, letters = [], 0
        for pages in batches:
            for page, html in zip(*pages.columns):
                parser = _Elements()
                parser.feed(html.as_py() or "")
                parser.close()
                for r in parser.elements():
                    rows.append([page.as_py(), *r])
                    letters += len(r[5])
                    if len(rows) >= ROWS or letters >= LETTERS:
                        yield batch(rows)
                        rows, letters = [], 0
        if rows:
            yield batch(rows)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, SCHEMA)


def _up_to() -> Window:
    return Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _from_here() -> Window:
    return Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)


def carried(elements: DataFrame, value: Column, name: str, back: bool = False) -> DataFrame:
    """WIN10, WIN11: each row gets the nearest preceding (or following) value that isn't null."""
    return elements.withColumn(name, F.first(value, ignorenulls=True).over(_from_here()) if back else F.last(value, ignorenulls=True).over(_up_to()))


def sections(elements: DataFrame, boundary: Column) -> DataFrame:
    """EXT9: number of the section of each row: boundaries so far."""
    return elements.withColumn("section", F.sum(F.when(boundary, 1).otherwise(0)).over(_up_to()))


#: A dollar sign and a number. Signs in a row ("$$$ 12") say how dear a place is or are noise, and what follows them is no price.
PRICE = r"(?<!\$)\$\s*(\d+(?:\.\d{1,2})?)"


def priced_items(elements: DataFrame, price: str = PRICE) -> DataFrame:
    """EXT1: list items and paragraphs of up to 300 characters with a price, under the nearest heading of under 80; the name is
    what stands before the dash and the first price; the lowest price is text with two decimals."""
    heading = F.when(F.col("tag").rlike("^h[1-6]$") & (F.length("text") < 80) & (F.col("text") != ""), F.col("text"))
    rows = carried(elements, heading, "parent").filter(F.col("tag").isin("li", "p") & (F.length("text") <= 300) & F.col("text").rlike(price))
    lowest = F.array_min(F.transform(F.regexp_extract_all("text", F.lit(price), F.lit(1)), price_of))["text"]
    return rows.select("page_id", "pos", "parent", F.trim(F.regexp_extract("text", rf"^(.*?)(?:\s+[-–—])?\s*{price}", 1)).alias("name"), lowest.alias("price"))


def labelled_items(elements: DataFrame, labels: dict[str, str], boundary: Column, parent: Column) -> DataFrame:
    """EXT2, EXT3, UDF5: items of sections that hold a label; the boundary and labels are the configuration of a source."""
    label = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[F.lower(F.rtrim("text", F.lit(":")))]
    rows = sections(elements, boundary)
    w = Window.partitionBy("page_id", "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("category", F.last(F.when(F.col("tag") != "li", label), ignorenulls=True).over(w)).withColumn("parent", F.first(F.when(boundary, parent), ignorenulls=True).over(w))
    return rows.filter((F.col("tag") == "li") & F.col("category").isNotNull() & F.col("parent").isNotNull()).select("page_id", "section", "pos", "parent", "category", F.col("text").alias("name"))


def layout(elements: DataFrame, boundary: Column) -> DataFrame:
    """EXT4: by page, whether it has boundary paragraphs or headings."""
    return elements.groupBy("page_id").agg(F.when(F.bool_or(boundary), "boundary").otherwise("headings").alias("layout"))


def restored_names(items: DataFrame, short: str, long: str) -> DataFrame:
    """AGG5: where a short name repeats inside a section, the long one stands."""
    n = F.count("*").over(Window.partitionBy("page_id", "section", short))
    return items.withColumn("shown", F.when(n > 1, F.col(long)).otherwise(F.col(short)))


def captioned_images(elements: DataFrame, junk: str, least: int = 120, later: bool = False) -> DataFrame:
    """EXT5, WIN9: images with the caption that follows, of 3 to 160 characters, no junk, of at least ``least`` pixels where sizes are
    declared; of a repeated image the first caption. If that one is unfit the image is left out or, with ``later``, gets its first fit caption."""
    rows = carried(elements, F.when(F.col("tag").isin("figcaption") | F.coalesce(F.col("class").contains("caption-text"), F.lit(False)), F.col("text")), "caption", back=True).filter("tag = 'img' and src is not null")
    shown = ~F.col("src").rlike(junk) & (F.coalesce("width", F.lit(least)) >= least) & (F.coalesce("height", F.lit(least)) >= least)
    fit = F.length("caption").between(3, 160) & ~F.col("caption").rlike(junk)
    first = rows.filter(shown & fit if later else shown).groupBy("page_id", "src").agg(F.min_by(F.struct("pos", "caption"), "pos").alias("c"))
    return first.select("page_id", "src", "c.pos", "c.caption").filter(fit)


def majority(votes: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """AGG4, EXT6: of votes (page_id, name) the winner, with at least ``least`` votes and more than ``share`` of all."""
    n = votes.groupBy("page_id", "name").agg(F.count("*").alias("n"))
    g = n.groupBy("page_id").agg(F.max(F.struct("n", "name")).alias("w"), F.sum("n").alias("all"))
    return g.filter((F.col("w.n") >= least) & (F.col("w.n") > share * F.col("all"))).select("page_id", F.col("w.name").alias("name"), F.col("w.n").alias("votes"))


def links(elements: DataFrame, keep: str) -> DataFrame:
    """SRC6: anchors in order of first appearance, each address once."""
    a = elements.filter(F.col("tag") == "a").filter(F.col("href").rlike(keep))
    return a.groupBy("page_id", "href").agg(F.min("pos").alias("pos"))


def json_ld(pages: DataFrame) -> DataFrame:
    """JSN3: values of JSON-LD scripts, objects or members of lists; what does not parse is skipped."""
    bodies = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script"), F.lit(1))
    v = pages.select("page_id", F.explode(bodies).alias("body")).withColumn("v", F.try_parse_json("body")).filter("v is not null")
    lists = v.filter(F.schema_of_variant("v").startswith("ARRAY"))
    each = lists.select("page_id", F.explode(F.variant_get("v", "$", "array<variant>")).alias("v"))
    return v.filter(~F.schema_of_variant("v").startswith("ARRAY")).select("page_id", "v").unionByName(each).select("page_id", F.to_json("v").alias("value"))


def guide_photos(elements: DataFrame, stop: str = "(?i)kids") -> DataFrame:
    """EXT8: images with a description, each under the next heading that ends in "Menu"; nothing from the first heading that
    matches ``stop`` on. A leading badge and the word Menu are taken off."""
    is_heading = F.col("tag").rlike("^h[1-6]$")
    end = F.min(F.when(is_heading & F.col("text").rlike(stop), F.col("pos"))).over(Window.partitionBy("page_id"))
    rows = elements.withColumn("end", end).filter(F.col("end").isNull() | (F.col("pos") < F.col("end")))
    rows = carried(rows, F.when(is_heading & F.col("text").rlike(r"Menu\s*$"), F.col("text")), "menu", back=True)
    name = F.trim(F.regexp_replace(F.regexp_replace("menu", r"^NEW!?\s*", ""), r"\s*Menu\s*$", ""))
    return rows.filter("tag = 'img' and alt is not null and alt <> '' and menu is not null").select("page_id", "pos", "src", "alt", name.alias("parent"), F.trim(F.regexp_extract("alt", "^([^:]*)", 1)).alias("head"))
