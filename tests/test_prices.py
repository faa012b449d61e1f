"""Prices of any number of digits."""

from pyspark.sql import functions as F

from mergestone.operators import elements as E
from mergestone.plans import scalar_plans


def test_a_price_too_large_for_a_number_of_a_fixed_width(spark):
    html = "<h3>Mill</h3><ul><li>Bread - $ 4247042900896785 / $99 / $007.5</li><li>Gold - $123456789012345678901234567890123456789012345.1</li><li>Air - $000</li></ul>"
    items = E.priced_items(E.tokenised(spark.createDataFrame([(1, html)], "page_id long, html string")))
    assert {(r.name, str(r.price)) for r in items.collect()} == {("Bread", "7.50"), ("Gold", "123456789012345678901234567890123456789012345.10"), ("Air", "0.00")}


def test_prices_of_a_line_with_a_number_that_no_decimal_holds(spark, monkeypatch):
    lines = spark.createDataFrame([("a", 0, "$ 4247042900896785 or $12.5"), ("b", 1, "none"), ("c", 2, "$1000000 $999999.99"), ("d", 3, None)], "id string, n long, line string")
    monkeypatch.setattr(scalar_plans, "menu", lambda spark, sf_dir: lines)
    got = scalar_plans.mat1_prices(spark, None).orderBy(F.col("id")).collect()
    assert [tuple(r) for r in got if r.id != "d"] == [("a", 2, "12.50", "4247042900896785.00"), ("b", 0, None, None), ("c", 2, "999999.99", "1000000.00")]
    assert got[3].low is None and got[3].first is None
