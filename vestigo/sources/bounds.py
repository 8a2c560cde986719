"""Postings in blocks of documents with the largest weight of each term in each block, for searches that skip blocks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from vestigo.operators.blocks import SHIP_BYTES, fits, measure
from vestigo.operators.terms import Index
from vestigo.sources.tables import FEW_TERMS, agreed, term_bucket

#: Documents of a block at most, and a term's postings from which its maxima are saved; those of rarer terms are read instead.
BLOCK_DOCS, RARE = 4096, 64
_POSTINGS = "term string, `{id}` {kind}, tf bigint, share double, block string, bucket int"


class Bounds(NamedTuple):
    """postings(term, id, tf, share, block, bucket) and maxima(term, block, n, tf, share, bucket); share is tf / norm.

    A term and block may have several rows of maxima, each of some of its n postings.
    """

    postings: DataFrame
    maxima: DataFrame
    terms: DataFrame
    id: str
    buckets: int


def block_of(id: str, width: int, kind) -> Column:
    """Documents of about one length and near ids share a block: long ones have large counts, and would spoil short ones' bounds."""
    if isinstance(kind, IntegralType):
        place = F.expr(f"(cast(`{id}` as bigint) - pmod(cast(`{id}` as bigint), {int(width)}L)) div {int(width)}L")
    else:
        place = F.pmod(F.xxhash64(id), F.lit(width))
    return F.concat_ws(":", F.length(F.bin("length")), place)


def save_bounds(index: Index, path: str, width: int = BLOCK_DOCS, rare: int = RARE, ship_bytes: int = SHIP_BYTES) -> None:
    """Write a saved index's postings block by block, and the maxima of its common terms.

    The index holds its postings by bucket and term, and so they stay: documents go to them, in slices of whole blocks that are
    within ``ship_bytes``, and a slice's postings are written by the task that reads them. A block's maxima are those of one file's
    rows; a search merges what little of a block lies in several files. No posting is shuffled.
    """
    if index.settings is None:
        raise ValueError("the index was not loaded with its settings")
    id, buckets = index.settings.id, index.settings.buckets
    kind, spark = index.postings.schema[id].dataType, index.docs.sparkSession
    postings = index.postings.select("term", id, "tf", term_bucket(buckets).alias("bucket"))
    docs = index.docs.filter(F.col(id).isNotNull()).select(id, "length", "norm", block_of(id, width, kind).alias("block"))
    slices = max(1, -(-measure(docs, F.octet_length("block") + F.octet_length(F.col(id).cast("string")) + F.lit(16))[1] // ship_bytes))
    share = F.when(F.col("norm") > 0, F.col("tf") / F.col("norm"))
    for at in range(slices):
        held = docs if slices == 1 else docs.filter(F.pmod(F.xxhash64("block"), F.lit(slices)) == at)
        rows = postings.join(F.broadcast(held), id).select("term", id, "tf", share.alias("share"), "block", "bucket")
        rows.sortWithinPartitions("bucket", "term", "block").write.mode("append" if at else "overwrite").partitionBy(
            "bucket").parquet(f"{path}/postings")
    index.terms.filter(F.col("df") >= rare).select("term").write.mode("overwrite").parquet(f"{path}/common")
    common = spark.read.parquet(f"{path}/common")
    if fits(common, F.octet_length("term"), ship_bytes):
        common = F.broadcast(common)
    saved = spark.read.schema(_POSTINGS.format(id=id, kind=kind.simpleString())).parquet(f"{path}/postings")
    most = _runs(saved.select("bucket", "term", "block", "tf", "share").join(common, "term", "left_semi"))
    most.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/maxima")


def _runs(postings: DataFrame) -> DataFrame:
    """Maxima of each batch's rows: near those of all rows where rows of a term and block lie together."""
    keys = ["bucket", "term", "block"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(keys).aggregate([("tf", "count"), ("tf", "max"), ("share", "max")])
            yield from found.select([*keys, "tf_count", "tf_max", "share_max"]).rename_columns([*keys, "n", "tf", "share"]).combine_chunks().to_batches()

    return postings.select(*keys, "tf", "share").mapInArrow(add, "bucket int, term string, block string, n bigint, tf bigint, share double")


def _merged(maxima: DataFrame) -> DataFrame:
    return maxima.groupBy("bucket", "term", "block").agg(F.sum("n").alias("n"), F.max("tf").alias("tf"), F.max("share").alias("share"))


def _maxima(postings: DataFrame) -> DataFrame:
    return _merged(postings.withColumn("n", F.lit(1).cast("bigint")))


def load_bounds(spark: SparkSession, path: str, index: Index, **expected) -> Bounds:
    settings = agreed(index.settings, **expected)
    kind = index.postings.schema[settings.id].dataType.simpleString()
    postings = spark.read.schema(_POSTINGS.format(id=settings.id, kind=kind)).parquet(f"{path}/postings")
    maxima = spark.read.schema("term string, block string, n bigint, tf bigint, share double, bucket int").parquet(f"{path}/maxima")
    return Bounds(postings, maxima, index.terms, settings.id, settings.buckets)


def wanted(bounds: Bounds, terms: DataFrame) -> tuple[Bounds, DataFrame]:
    """Bounds cut down to the buckets of query terms, to the terms themselves while they are few; and the maxima of all of
    the terms, those of rare ones taken from their postings."""
    numbers = [r["bucket"] for r in terms.select(term_bucket(bounds.buckets).alias("bucket")).distinct().collect()]
    keep = F.col("bucket").isin(numbers)
    few = [r["term"] for r in terms.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    if len(few) <= FEW_TERMS:
        keep &= F.col("term").isin(few)
    cut = bounds._replace(postings=bounds.postings.filter(keep), maxima=bounds.maxima.filter(keep), terms=bounds.terms.filter(keep))
    known = cut.maxima.select("term").distinct()
    rare = terms.select("term").distinct().join(known, "term", "left_anti")
    return cut, _merged(cut.maxima).unionByName(_maxima(cut.postings.join(rare, "term", "left_semi")))
