"""Tables between the rounds of an iteration: written to the folder that all executors share, so that each round reads the last one's
rows instead of computing them again, and a lost executor costs no more than its tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mergestone.streaming.changes import shared_folder


def kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
