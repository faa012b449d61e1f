"""Of a repeated image the first caption decides, also where it is unfit."""

import duckdb
import pytest

from mergestone.operators import elements as E
from mergestone.plans import extract_plans as X
from mergestone.plans import queries as Q

HEADLINES = ["A.", "", " ", "a&amp;", "The", "Our sponsors", "Logo", "long " * 40, "Warm stew"]


@pytest.fixture
def sf_dir(spark, tmp_path):
    pages = [(k, "u", f"<html><body><h1>{t}</h1><p>Text</p></body></html>") for k, t in enumerate(HEADLINES * 7)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def stated(name, columns, sf_dir):
    return sorted(duckdb.execute(f"WITH pages AS (FROM read_parquet('{sf_dir}/pages.parquet/*.parquet')) SELECT {columns} FROM ({Q.ORACLE[name]})").fetchall())


def test_unfit_first_captions(spark):
    image = lambda src, caption, size="": f"<img src='/{src}.jpg'{size}><figcaption>{caption}</figcaption>"
    html = image("a", "A.") + image("a", "Stew") + image("b", "Sponsor") + image("b", "x") + image("c", "Small", " width='20'") + image("c", "Pie") + image("d", "Ale") + image("d", "Ale again") + "<img src='/e.jpg'>"
    e = E.tokenised(spark.createDataFrame([(1, html)], "page_id long, html string"))
    found = lambda **more: {(r.src, r.caption) for r in E.captioned_images(e, "(?i)sponsor", **more).collect()}
    assert found() == {("/c.jpg", "Pie"), ("/d.jpg", "Ale")}
    assert found(later=True) == {("/a.jpg", "Stew"), ("/c.jpg", "Pie"), ("/d.jpg", "Ale")}


def test_ext5_captioned_images_of_short_and_long_headlines(spark, sf_dir):
    want = stated("ext5_captioned_images", "page_id, src, caption", sf_dir)
    assert len(want) == 7 * 2
    assert sorted(map(tuple, X.ext5_captioned_images(spark, sf_dir).collect())) == want


def test_ext6_caption_records_of_short_and_long_headlines(spark, sf_dir):
    want = stated("ext6_caption_records", "page_id, parent, name, image", sf_dir)
    assert len(want) == 7 * 3
    assert sorted(map(tuple, X.ext6_caption_records(spark, sf_dir).collect())) == want
