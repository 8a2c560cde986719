"""Feature tables: named descriptors per item, local descriptors, codebook histograms."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigo.operators import blocks
from vestigo.operators.distances import distance_scores, nearest
from vestigo.operators.ranking import union_all
from vestigo.schemas import require

Extractor = Column | Callable[[pd.DataFrame], pd.Series]


def pipeline(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Several projections as one, for use on collection and queries alike."""
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df
    return run


def build_feature_table(df: DataFrame, id: str, extractors: Mapping[str, Extractor]) -> DataFrame:
    """Descriptors of every item in long form: (id, kind, vector, error).

    An extractor is a column expression or a function from a pandas frame to a series of number lists. When a
    function fails on a batch its rows are tried one by one; a failing row keeps a null vector and the error text.
    """
    columns = {kind: e for kind, e in extractors.items() if isinstance(e, Column)}
    functions = {kind: e for kind, e in extractors.items() if not isinstance(e, Column)}
    parts = []
    if columns:
        entries = F.array(*[
            F.struct(F.lit(kind).alias("kind"), e.cast("array<double>").alias("vector")) for kind, e in columns.items()])
        parts.append(df.select(id, F.explode(entries).alias("f")).select(
            id, "f.kind", "f.vector", F.lit(None).cast("string").alias("error")))
    if functions:
        id_type = df.schema[id].dataType.simpleString()

        def extract(frames):
            for frame in frames:
                for kind, function in functions.items():
                    vectors, errors = _try_batch(function, frame)
                    yield pd.DataFrame({id: frame[id], "kind": kind, "vector": vectors, "error": errors})

        parts.append(df.mapInPandas(extract, f"{id} {id_type}, kind string, vector array<double>, error string"))
    return union_all(parts)


def _try_batch(function, frame: pd.DataFrame) -> tuple[list, list]:
    try:
        return list(function(frame)), [None] * len(frame)
    except Exception:
        vectors, errors = [], []
        for at in range(len(frame)):
            try:
                vectors.append(list(function(frame.iloc[at:at + 1]))[0])
                errors.append(None)
            except Exception as problem:
                vectors.append(None)
                errors.append(f"{type(problem).__name__}: {problem}")
        return vectors, errors


def good_features(table: DataFrame) -> DataFrame:
    return table.filter(F.col("error").isNull()).drop("error")


def failed_features(table: DataFrame, id: str) -> DataFrame:
    return table.filter(F.col("error").isNotNull()).select(id, "kind", "error")


def repeated_ids(table: DataFrame, id: str) -> DataFrame:
    """(id, kind, n) of descriptors that occur more than once; empty when the table is sound."""
    return table.groupBy(id, "kind").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def feature_lists(parts: Mapping[str, DataFrame], id: str = "id", vector: str = "vector") -> DataFrame:
    """Several descriptor frames of the same items as one searchable table (id, kind, vector)."""
    return union_all([
        df.select(id, F.lit(kind).alias("kind"), F.col(vector).cast("array<double>").alias("vector"))
        for kind, df in parts.items()])


def local_descriptors(df: DataFrame, id: str = "id", nested: str = "descriptors") -> DataFrame:
    """Nested descriptors in long form: (id, pos, vector)."""
    return df.select(id, F.posexplode(nested).alias("pos", "vector"))


def cut_vectors(df: DataFrame, width: int, id: str = "id", vector: str = "vector") -> DataFrame:
    """Long form of one vector per item cut into consecutive slices: (id, pos, vector)."""
    require(df, id, vectors=(vector,))
    starts = F.sequence(F.lit(0), F.ceil(F.size(vector) / F.lit(width)).cast("int") - 1)
    slices = F.transform(starts, lambda i: F.slice(F.col(vector).cast("array<double>"), i * width + 1, F.lit(width)))
    return local_descriptors(df.filter(F.size(vector) > 0).select(id, slices.alias("descriptors")), id)


def join_vectors(local: DataFrame, id: str = "id") -> DataFrame:
    """Slices of one item joined back to one vector, in position order."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "vector")))
    return local.groupBy(id).agg(F.flatten(F.transform(parts, lambda p: p["vector"])).alias("vector"))


def assign_words(local: DataFrame, codebook: DataFrame, id: str = "id", digits: int | None = None,
                 ship_bytes: int = blocks.SHIP_BYTES) -> DataFrame:
    """Nearest codebook entry of every local descriptor: (id, pos, word, distance); ties go to the lower word.

    ``codebook`` has (word, vector). A codebook of measured small size is shipped to the tasks, which then need no
    shuffle; a larger one goes through the blockwise nearest search.
    """
    require(local, id, "pos", vectors=("vector",))
    require(codebook, "word", vectors=("vector",))
    size = F.size("vector") * 8
    book, _, _ = blocks.fetch_small(codebook.select("word", "vector").orderBy("word"), size, ship_bytes)
    if book is None:
        keyed = local.select(F.struct(id, "pos").alias("query_id"), "vector")
        found = nearest(codebook, keyed, 1, "l2", id="word", digits=digits, ship_bytes=ship_bytes)
        return found.select(f"query_id.{id}", "query_id.pos", "word", "distance")
    spark = local.sparkSession
    schema = (f"{id} {local.schema[id].dataType.simpleString()}, pos {local.schema['pos'].dataType.simpleString()}, "
              f"word {codebook.schema['word'].dataType.simpleString()}, distance double")

    if not book.num_rows:
        return spark.createDataFrame([], schema)
    words = spark.sparkContext.broadcast(blocks.pack(book))

    def assign(batches):
        book = blocks.unpack(words.value)
        centres, names = book.column("vector"), book.column("word").combine_chunks()
        for batch in batches:
            best_word = np.zeros(batch.num_rows, dtype=np.int64)
            best = np.full(batch.num_rows, np.nan)
            rows = max(1, (1 << 22) // max(len(names), 1))
            for first in range(0, batch.num_rows, rows):
                part = pa.chunked_array([batch.column("vector").slice(first, rows)])
                for at, scores in distance_scores(part, centres, "l2", 1, digits, cells=1 << 62):
                    scores[np.isnan(scores)] = -np.inf
                    word = scores.argmax(1)
                    best_word[first:first + len(word)] = word
                    best[first:first + len(word)] = -scores[np.arange(len(word)), word]
            ok = pa.array(np.isfinite(best))
            out = pa.RecordBatch.from_arrays(
                [batch.column(id), batch.column("pos"), names.take(pa.array(best_word)), pa.array(best)],
                names=[id, "pos", "word", "distance"])
            yield out.filter(ok)

    usable = local.select(id, "pos", "vector").filter(F.col("vector").isNotNull())
    return usable.mapInArrow(assign, schema)


def word_histogram(words: DataFrame, id: str = "id") -> DataFrame:
    """(id, word, n): how many local descriptors of an item fell on each word; counted in the tasks first."""
    return words.groupBy(id, "word").agg(F.count(F.lit(1)).alias("n"))


def dense_histogram(histogram: DataFrame, n_words: int, id: str = "id", items: DataFrame | None = None) -> DataFrame:
    """Dense form (id, vector) with zeros for the words an item lacks; a word outside 0 .. n_words - 1 raises.

    With ``items`` every id listed there has a histogram, of zeros when it has no words.
    """
    wrong = F.raise_error(F.concat(F.lit(f"a word outside 0 to {n_words - 1}: "), F.col("word").cast("string")))
    inside = F.when((F.col("word") >= 0) & (F.col("word") < n_words), F.col("word")).otherwise(wrong)
    histogram = histogram.withColumn("word", inside.cast(histogram.schema["word"].dataType))
    counts = F.map_from_entries(F.collect_list(F.struct("word", "n")))
    bins = F.transform(F.sequence(F.lit(0), F.lit(n_words - 1)),
                       lambda w: F.coalesce(F.try_element_at(F.col("counts"), w.cast(histogram.schema["word"].dataType)),
                                            F.lit(0)).cast("double"))
    counted = histogram.groupBy(id).agg(counts.alias("counts"))
    if items is not None:
        none = F.create_map().cast(counted.schema["counts"].dataType)
        counted = items.select(id).distinct().join(counted, id, "left").withColumn("counts", F.coalesce("counts", none))
    return counted.select(id, bins.alias("vector"))


def sparse_histogram(dense: DataFrame, id: str = "id", vector: str = "vector") -> DataFrame:
    """(id, word, n) of dense histograms, bins cut to integers, empty bins left out."""
    return (dense.select(id, F.posexplode(vector).alias("word", "n"))
            .select(id, "word", F.col("n").cast("bigint").alias("n")).filter("n >= 1"))


def histogram_terms(histogram: DataFrame, id: str = "id", first_bin: int = 1) -> DataFrame:
    """A histogram (id, word, n) as postings (term, id, tf); bin 0 gives no term unless ``first_bin=0``."""
    return (histogram.select(id, "word", F.col("n").cast("bigint").alias("tf"))
            .filter((F.col("word") >= first_bin) & (F.col("tf") >= 1))
            .select(F.concat(F.lit("v"), F.col("word").cast("string")).alias("term"), id, "tf"))
