"""A training-corpus pipeline: toxic documents go, near-duplicates go, contaminated documents go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from mergestone.llm.decontamination import without_contaminated
from mergestone.llm.noisy_channel import without_toxic
from mergestone.llm.piece_scan import encode_texts
from mergestone.llm.shared import written
from mergestone.llm.simhash import without_near_duplicates

#: Bytes of the rows that go to Python at a time. A batch stands in the JVM and in the worker at once, in two or three copies, and tasks
#: side by side each have theirs, so Spark's 64 MB takes a large part of a small executor. A longer row is a batch by itself.
BATCH = 4 << 20
BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` in batches of :data:`BATCH`. The session keeps that setting, as what the stage returns is not computed yet."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BYTES_PER_BATCH, BATCH)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.7 or more."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@bounded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group with five-word shingles 0.8 or more alike."""
    return without_near_duplicates(docs)


@bounded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@bounded
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_chunks, ids) of the whole texts that are left."""
    import public_tokenizers

    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", encoding)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BYTES_PER_BATCH)
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
    finally:
        spark.conf.set(BYTES_PER_BATCH, before)
    return docs
