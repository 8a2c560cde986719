"""Term tables of a text collection: counts per document, document frequency, posting lists, index tables."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from vestigo.functions.text import BLANK, tokens
from vestigo.schemas import require


# Texts of a batch that are counted at a time.
COUNTED = 1 << 10
# Weights of an index shipped to its postings at most.
FREQUENT = 1 << 18


class IndexSettings(NamedTuple):
    """How a saved index was built; kept with it, so that searches and refreshes cannot use other settings."""

    buckets: int
    pattern: str
    stop_words: tuple[str, ...]
    id: str
    text: str


class Index(NamedTuple):
    """An inverted index as tables: postings(term, doc_id, tf), terms(term, df, idf), docs(doc_id, length, norm)."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    settings: IndexSettings | None = None


def token_rows(docs: DataFrame, id: str = "doc_id", text: str = "text", pattern: str = BLANK,
               stop_words: Iterable[str] = ()) -> DataFrame:
    """One row per token occurrence: (id, term)."""
    require(docs, id, text)
    rows = docs.select(id, F.explode(F.split(F.lower(text), pattern)).alias("term")).filter("term <> ''")
    stop = sorted(set(stop_words))
    return rows.filter(~F.col("term").isin(stop)) if stop else rows


def drop_stop_words(token_table: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Token or posting rows whose term is not listed in a stop word table."""
    return token_table.join(stop_words.select(F.lower("word").alias("term")), "term", "left_anti")


def term_frequencies(docs: DataFrame, id: str = "doc_id", text: str = "text", pattern: str = BLANK,
                     stop_words: Iterable[str] = ()) -> DataFrame:
    """Postings (term, id, tf). Grouping by term and document spreads even a term that every document holds."""
    rows = token_rows(docs, id, text, pattern, stop_words)
    return rows.groupBy("term", id).agg(F.count(F.lit(1)).alias("tf"))


def counted_terms(docs: DataFrame, id: str = "doc_id", text: str = "text", pattern: str = BLANK,
                  stop_words: Iterable[str] = ()) -> DataFrame:
    """``term_frequencies`` of a stored collection: without a shuffle when no two rows have the same id.

    A row's tokens are then counted where it is read. The ids are looked through first, so give frames whose ids are cheap to read.
    """
    require(docs, id, text)
    if not docs.groupBy(id).count().filter("count > 1").isEmpty():
        return term_frequencies(docs, id, text, pattern, stop_words)
    rows = docs.select(F.col(id), tokens(text, pattern, sorted(set(stop_words))).alias("_tokens")).filter(F.size("_tokens") > 0)

    def count(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, COUNTED):
                ids, lists = batch.column(0).slice(first, COUNTED), batch.column(1).slice(first, COUNTED)
                words = lists.flatten().dictionary_encode()
                n = max(len(words.dictionary), 1)
                pair, tf = np.unique(pc.list_parent_indices(lists).to_numpy().astype(np.int64) * n + words.indices.to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(pair % n)), ids.take(pa.array(pair // n)), pa.array(tf, pa.int64())],
                                                 ["term", id, "tf"])

    return rows.mapInArrow(count, f"term string, `{id}` {docs.schema[id].dataType.simpleString()}, tf bigint")


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term occurs."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def posting_segments(postings: DataFrame, width: int, id: str = "doc_id") -> DataFrame:
    """Posting lists as arrays, newest document first, cut into segments of ``width`` consecutive numeric ids.

    A term's whole list is its segments in descending order; no array grows beyond ``width`` entries, however
    common the term. Ids of another type have no neighbours to count: their segment is one of ``width`` by the ids'
    MD5, and every segment lists its ids in descending order.
    """
    if isinstance(postings.schema[id].dataType, IntegralType):
        segment = F.expr(f"({{0}} - pmod({{0}}, {int(width)}L)) div {int(width)}L".format(f"cast(`{id}` as bigint)"))
    else:
        segment = F.conv(F.substring(F.md5(F.col(id).cast("string")), 1, 8), 16, 10).cast("bigint") % F.lit(width)
    entry = F.struct(F.col(id), F.col("tf"))
    return (postings.groupBy("term", segment.alias("segment"))
            .agg(F.sort_array(F.collect_list(entry), asc=False).alias("postings")))


def collection_size(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row: number of documents."""
    return docs.agg(F.count(id).alias("n_docs"))


def term_weights(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln(N / df), N counting all documents."""
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    return document_frequencies(postings).withColumn("idf", F.log(n.scalar() / F.col("df")))


def document_norms(postings: DataFrame, weights: DataFrame, docs: DataFrame, id: str = "doc_id", most: int | None = None) -> DataFrame:
    """(id, length, norm): tokens of each document and the root of their summed squared idf; 0 without tokens.

    Give saved tables, and ``most``: at most so many weights, those of the terms of highest document frequency, are then shipped to
    the postings, and tasks sum up what they read of a document. Only postings of rarer terms are shuffled by term, or those of
    all terms without ``most``; Spark splits the tasks of very common terms.
    """
    rows, of = postings.select("term", id, "tf"), weights.select("term", "idf")
    if most is None:
        found = rows.join(of, "term")
    else:
        least = _frequent_from(weights, most)
        known = F.broadcast(weights.filter(F.col("df") >= least).select("term", "idf"))
        found = rows.join(known, "term")
        if least:
            rare = rows.join(F.broadcast(known.select("term")), "term", "left_anti")
            found = found.unionByName(rare.join(weights.filter(F.col("df") < least).select("term", "idf"), "term"))
    square = F.col("idf") * F.col("idf")
    lengths = found.groupBy(id).agg(F.sum("tf").alias("length"), F.sqrt(F.sum(F.col("tf") * square)).alias("norm"))
    return (docs.select(id).join(lengths, id, "left")
            .select(id, F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("norm", F.lit(0.0)).alias("norm")))


def _frequent_from(weights: DataFrame, most: int) -> int:
    """The smallest document frequency that at most ``most`` terms reach, 0 when no term is rarer.

    Only the table of frequencies is added up in one place.
    """
    found = weights.groupBy("df").agg(F.count(F.lit(1)).alias("terms"))
    sums = found.withColumn("kept", F.sum("terms").over(Window.orderBy(F.desc("df"))))
    row = sums.agg(F.min(F.when(F.col("kept") <= most, F.col("df"))).alias("least"), F.min("df").alias("rarest"), F.max("df").alias("largest")).first()
    if row["least"] == row["rarest"]:
        return 0
    return row["least"] or row["largest"] + 1
