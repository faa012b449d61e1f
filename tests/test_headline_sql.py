"""The headline in SQL against the parser's rule, for references that the end of a headline cuts off and for white space of all kinds."""

import html

import duckdb
import pytest

from mergestone.plans.extract_plans import TITLE


@pytest.mark.parametrize("text", ["and &amp", "and &am", "&amp;lt; a", "it&#x27;s", "it&#x27", "it&#x2", "it&#x", "it&#", "it&#x27 is", "a &lt b &gtc", "&quot", "&amp;#x27", "&amp;amp", "\xa0a\x85 　\x0bb "])
def test_headline(text):
    got = duckdb.execute(f"SELECT {TITLE} FROM (SELECT ? AS html)", [f"<h1>{text}</h1>"]).fetchone()[0]
    assert got == " ".join(html.unescape(text).split())
