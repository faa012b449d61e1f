"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergestone.llm.importance_resampling import SQL as SQL_12
from mergestone.llm.substring_dedup import SQL as SQL_13


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergestone.llm.noisy_channel import score_toxicity

    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergestone.llm.log_bilinear import score_documents

    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from mergestone.llm.piece_scan import encode_texts

    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergestone.llm.product_quantisation import embedding_classes

    return embedding_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergestone.llm.html_text import extract_text

    found = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from mergestone.llm.token_files import read_token_files, write_token_files

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json")), digest=True)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergestone.llm.license_scan import scan_licenses

    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergestone.llm.simhash import simhash_classes

    return simhash_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergestone.llm.decontamination import contaminated

    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergestone.llm.tool_calls import SCHEMAS, link_tool_calls, with_tool_calls

    return link_tool_calls(with_tool_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")), SCHEMAS)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergestone.llm.periodic_runs import find_runs, run_digests, with_planted_runs

    return run_digests(find_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergestone.llm.importance_resampling import resampled

    found = resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergestone.llm.substring_dedup import without_repeated_passages

    found = without_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_token_files": op6_token_files,
    "op7_license_scan": op7_license_scan,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_substring_dedup": op13_substring_dedup,
}

#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLE: dict[str, str] = {"op12_importance_resampling": SQL_12, "op13_substring_dedup": SQL_13}
