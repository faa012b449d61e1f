"""A number behind several dollar signs is no price: neither a row of a paragraph nor the end of an item's name."""

import duckdb

from mergestone.operators import elements as E
from mergestone.plans import extract_plans as X
from mergestone.plans import queries as Q


def test_numbers_behind_dollar_signs_in_a_row(spark):
    html = "<h3>Mill</h3><p>er%%% chteie$$$ 4247042900896785$$$ schein</p><p>Stew $$$ 12 - $ 9 / $8.5</p><ul><li>A$$$ - $3.50</li><li>Pie$4</li><li>$$5</li></ul>"
    items = E.priced_items(E.tokenised(spark.createDataFrame([(1, html)], "page_id long, html string")))
    assert {(r.name, r.price) for r in items.collect()} == {("Stew $$$ 12", "8.50"), ("A$$$", "3.50"), ("Pie", "4.00")}


def test_ext1_priced_items_on_pages_with_noise(spark, tmp_path):
    menu = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("la", "de$$$", "$$$", "a$"))
    pages = [(k, "u", f"<ul>{menu}</ul><h1>Das.$$$ und</h1><p>teie$$$ {n}{end} ein*** zu%%%</p>") for k, (n, end) in enumerate([("4247042900896785", "$$$"), ("170.116.163.254", "###"), ("5", "")])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.execute(f"WITH pages AS (FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')) SELECT page_id, name, price FROM ({Q.ORACLE['ext1_priced_items']})").fetchall()
    assert len(want) == 12
    assert sorted(map(tuple, X.ext1_priced_items(spark, str(tmp_path)).collect())) == sorted(want)
