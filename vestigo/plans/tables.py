"""Access to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vestigo.sources.readers import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, in enough tasks for work on whole texts."""
    return spread(table(spark, folder, "documents"), "doc_id")
