"""Element rows leave a task in small batches, and texts of nested elements are what is inside them."""

import random

import pyarrow as pa

from mergestone.operators import elements as E


def test_rows_of_many_pages_come_in_batches_of_bounded_size(spark, monkeypatch):
    run = []

    class Pages:
        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            run.append(f)

        mapInPandas = mapInArrow

    E.tokenised(Pages())
    html = "<div>" + "<p>one <b>two</b></p>" * 100 + "</div>"
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(200)), "html": [html] * 200})
    sizes = [out.num_rows for out in run[0](iter([pages]))]
    assert sum(sizes) == 200 * 101 and max(sizes) <= 2_000


def test_texts_of_nested_and_open_elements(spark):
    rng = random.Random(5)
    parts = ["<div>", "</div>", "<p>", "</p>", "<li>", "<span>", "</span>", "<img alt='x'>", "a ", " b", "&amp;", " ", "<script>no</script>", "<br>"]
    pages = [(k, "".join(rng.choices(parts, k=rng.randrange(60)))) for k in range(50)] + [(90, None), (91, "")]
    got = {(r.page_id, r.pos): r.text for r in E.tokenised(spark.createDataFrame(pages, "page_id long, html string")).collect()}

    class Plain(E._Elements):  # each piece of text goes to all elements that are open
        def handle_data(self, data):
            if not self.skip and data.strip():
                self.data.append(data)
                for _, at in self.stack:
                    if at is not None:
                        said.setdefault(at, []).append(data)

    want = {}
    for page, html in pages:
        said, parser = {}, Plain()
        parser.feed(html or "")
        parser.close()
        want |= {(page, r[0]): " ".join("".join(said.get(r[0], [])).split()) for r in parser.rows}
    assert got == want
