"""From raw documents to training tokens: reject poor texts, drop repeated lines and near copies, mix sources, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigo.llm import line_dedup, mixing, quality, queries, simhash
from vestigo.llm.common import unused
from vestigo.sources.tables import written


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts; it is trained on the stage's own documents."""
    rows = quality.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, quality.train(rows))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` as a written table with a unique number that rises with the id, as column ``name``; rows without an id come last."""
    order = F.col("doc_id").cast("long").asc_nulls_last(), F.xxhash64("text")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that few large tasks are not made of them
    spread = docs.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return written(spread.withColumn(name, F.monotonically_increasing_id()), "numbered")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; each document stays, even when no line is left.

    Rows are told apart by number, so that null and repeated ids are documents like any other.
    """
    row = unused(docs, "row")
    rows = numbered(docs, row)
    found = line_dedup.line_classes(rows.select(F.col(row).alias("doc_id"), "text"))
    return line_dedup.without_lines(rows, found.filter("not kept").select("doc_id", "line"), row).drop(row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; one row of it when ids are null or repeated."""
    row = unused(docs, "row")
    rows = numbered(docs, row)
    found = simhash.simhash_components(rows.select(F.col(row).alias("doc_id"), "text"))
    gone = written(found.filter("component <> doc_id").select(F.col("doc_id").alias(unused(rows, "gone"))), "gone")
    return rows.join(gone, F.col(row) == F.col(gone.columns[0]), "left_anti").drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text, one row for each row of the mix."""
    return queries.encoded_digests(docs)


STAGES = [("quality", reject_poor), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("mixing", mix_sources),
          ("encoding", encode)]

#: No stage but the mix can be said in SQL; the tests hold the whole run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
