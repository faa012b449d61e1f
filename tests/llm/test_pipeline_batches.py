import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture(autouse=True)
def as_before(spark):
    before = spark.conf.get(KEY)
    yield
    spark.conf.set(KEY, before)


def largest(docs):
    """(bytes of the largest batch, rows of all)"""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes], "n": [b.num_rows]})

    return docs.mapInArrow(sizes, "size long, n long").agg(F.max("size"), F.sum("n")).first()


def test_texts_of_a_stage_go_to_python_in_small_batches(spark):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('x', 10000)").alias("text"))
    assert largest(docs)[0] > 25e6
    corpus_pipeline.encoding(spark, docs.limit(3), "")
    assert largest(docs)[0] < 5e6
    assert largest(docs)[1] == 3000


def test_the_pipeline_leaves_the_setting_as_it_was(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text of no harm", "en", "x", 20)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item of the benchmark that is not in any text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.conf.get(KEY)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    assert spark.conf.get(KEY) == before
