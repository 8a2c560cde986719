"""Inverted index in segments: a refresh adds the postings of changed documents and voids the old ones.

A folder holds segments and a log. A segment has ``postings`` (partitioned by term bucket, as in a saved index), ``hashes``
(id, hash) of its documents, and ``gone``, the ids whose entries in earlier segments no longer hold. Every row of the
log lists the segments in force, in order; the last row counts. One writer at a time; readers keep the list they opened.
Searches read the wanted buckets of all segments and leave out voided documents, so a refresh rewrites nothing. Many
segments are merged into one by ``compact``, which drops what is voided.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigo.functions.text import BLANK
from vestigo.operators.refresh import content_hashes
from vestigo.operators.terms import FREQUENT, Index, IndexSettings, counted_terms, document_norms
from vestigo.sources.tables import BUCKETS, agreed, write_postings

#: Segments are merged when there are more than this many of about one size, the tier: sizes within a factor of TIER.
MOST_SEGMENTS, TIER = 8, 4


class Segment(NamedTuple):
    """Name of a segment's folder, its documents and postings, and whether it voids anything."""

    name: str
    n_docs: int
    n_postings: int
    n_gone: int


def _log(spark: SparkSession, path: str) -> tuple[int, IndexSettings, list[Segment]]:
    try:
        rows = spark.read.schema("number long, record string").parquet(f"{path}/log").orderBy(F.desc("number")).limit(1).collect()
    except AnalysisException:
        rows = []
    if not rows:
        raise ValueError(f"no index in segments at {path}")
    record = json.loads(rows[0]["record"])
    settings = IndexSettings(**record["settings"] | {"stop_words": tuple(record["settings"]["stop_words"])})
    return rows[0]["number"], settings, [Segment(*s) for s in record["segments"]]


def _commit(spark: SparkSession, path: str, number: int, settings: IndexSettings, segments: list[Segment]) -> None:
    record = json.dumps({"settings": settings._asdict(), "segments": segments})
    spark.createDataFrame([(number, record)], "number long, record string").coalesce(1).write.mode("append").parquet(f"{path}/log")


def _read(spark: SparkSession, path: str, name: str, part: str, id: str) -> DataFrame:
    """A part of a segment; the folder of postings may hold no file, so its columns are named."""
    if part != "postings":
        return spark.read.parquet(f"{path}/{name}/{part}")
    kind = spark.read.parquet(f"{path}/{name}/hashes").schema[id].dataType.simpleString()
    return spark.read.schema(f"term string, `{id}` {kind}, tf bigint, bucket int").parquet(f"{path}/{name}/postings")


def _live(spark: SparkSession, path: str, segments: list[Segment], part: str, id: str, first: int = 0) -> DataFrame:
    """Rows of a part over segments from ``first`` on, each without the documents that later segments void."""
    frames = []
    for at, segment in enumerate(segments[first:], first):
        rows = _read(spark, path, segment.name, part, id)
        later = [_read(spark, path, s.name, "gone", id) for s in segments[at + 1:] if s.n_gone]
        if later:
            rows = rows.join(reduce(DataFrame.unionByName, later), id, "left_anti")
        frames.append(rows)
    return reduce(DataFrame.unionByName, frames)


def create(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", pattern: str = BLANK,
           stop_words: Iterable[str] = (), buckets: int = BUCKETS) -> Index:
    """Write an index with one segment that holds all documents. Ids must be unique; rows without an id are left out."""
    settings = IndexSettings(buckets, pattern, tuple(sorted(set(stop_words))), id, text)
    spark = docs.sparkSession
    docs = docs.filter(F.col(id).isNotNull())
    name = _fresh()
    content_hashes(docs, id, text).write.parquet(f"{path}/{name}/hashes")
    write_postings(counted_terms(docs, id, text, pattern, settings.stop_words), f"{path}/{name}/postings", buckets)
    _commit(spark, path, 0, settings, [_measured(spark, path, name, 0, id)])
    return load(spark, path)


def _fresh() -> str:
    return f"segment-{uuid.uuid4().hex[:12]}"


def _measured(spark: SparkSession, path: str, name: str, n_gone: int, id: str) -> Segment:
    """Row counts come from the files' footers."""
    counts = [_read(spark, path, name, part, id).count() for part in ("hashes", "postings")]
    return Segment(name, *counts, n_gone)


def refresh(docs: DataFrame, path: str, **expected) -> Index:
    """Bring the index up to the given documents: a new segment with the postings of new and changed ones only.

    Texts are hashed once and compared with the hashes in force. A document that vanished or changed is listed as gone.
    Nothing is written when nothing differs. Settings given here must agree with those of the index.
    """
    spark = docs.sparkSession
    number, settings, segments = _log(spark, path)
    settings = agreed(settings, **expected)
    id, text = settings.id, settings.text
    docs = docs.filter(F.col(id).isNotNull())
    name = _fresh()
    folder = f"{path}/{name}"
    content_hashes(docs, id, text).write.parquet(f"{folder}/seen")
    seen, stored = spark.read.parquet(f"{folder}/seen"), _live(spark, path, segments, "hashes", id)
    stored.join(seen, [id, "hash"], "left_anti").select(id).write.parquet(f"{folder}/gone")
    seen.join(stored, [id, "hash"], "left_anti").write.parquet(f"{folder}/hashes")
    fresh, n_gone = spark.read.parquet(f"{folder}/hashes"), spark.read.parquet(f"{folder}/gone").count()
    if not n_gone and fresh.isEmpty():
        return load(spark, path)
    changed = docs.select(id, text).join(fresh.select(id), id, "left_semi")
    write_postings(counted_terms(changed, id, text, settings.pattern, settings.stop_words), f"{folder}/postings", settings.buckets)
    _commit(spark, path, number + 1, settings, [*segments, _measured(spark, path, name, n_gone, id)])
    return load(spark, path)


def load(spark: SparkSession, path: str, **expected) -> Index:
    """The index in force, as live postings, terms and documents.

    Terms are counted from live postings by bucket, so that a search counts its own terms only. Lengths and norms of
    documents follow from the current weights of all terms: they are read when ``save_norms`` wrote them for these
    segments, else computed from postings when asked for.
    """
    number, settings, segments = _log(spark, path)
    settings = agreed(settings, **expected)
    id = settings.id
    postings = _live(spark, path, segments, "postings", id).select("term", id, "tf", "bucket")
    ids = _live(spark, path, segments, "hashes", id).select(id)
    n = ids.agg(F.count(F.lit(1)).cast("double").alias("n"))
    terms = postings.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).select(
        "term", "df", F.log(n.scalar() / F.col("df")).alias("idf"), "bucket")
    try:
        docs = spark.read.parquet(f"{path}/norms-{number}")
    except AnalysisException:
        docs = document_norms(postings, terms, ids, id)
    return Index(postings, terms, docs, settings)


def save_norms(spark: SparkSession, path: str) -> Index:
    """Write lengths and norms for the segments in force, for searches with weights. Postings stay as they are.

    Term weights are written first, so that Spark knows both sides of the join and splits the tasks of common terms.
    """
    number, settings, _ = _log(spark, path)
    index = load(spark, path)
    index.terms.select("term", "df", "idf").write.mode("overwrite").parquet(f"{path}/weights-{number}")
    ids = _live(spark, path, _log(spark, path)[2], "hashes", settings.id).select(settings.id)
    norms = document_norms(index.postings, spark.read.parquet(f"{path}/weights-{number}"), ids, settings.id, FREQUENT)
    norms.write.mode("overwrite").parquet(f"{path}/norms-{number}")
    return load(spark, path)


def tiers(segments: list[Segment], most: int = MOST_SEGMENTS, factor: int = TIER) -> int:
    """The first segment of the run at the end that is to be merged: as many as are no larger than ``factor`` times what
    follows them, once there are more than ``most`` segments; the number of segments when there is nothing to do."""
    if len(segments) <= most:
        return len(segments)
    first, total = len(segments) - 1, segments[-1].n_postings
    while first and segments[first - 1].n_postings <= factor * max(total, 1):
        first -= 1
        total += segments[first].n_postings
    return min(first, most - 1)


def compact(spark: SparkSession, path: str, first: int | None = None) -> Index:
    """Merge the segments from ``first`` on (by default as ``tiers`` says) into one that holds their live rows only.

    What a merged segment voids in segments before ``first`` stays listed. Older segments are left on disk for readers.
    """
    number, settings, segments = _log(spark, path)
    first = tiers(segments) if first is None else first
    if first >= len(segments):
        return load(spark, path)
    name, id = _fresh(), settings.id
    _live(spark, path, segments, "hashes", id, first).write.parquet(f"{path}/{name}/hashes")
    write_postings(_live(spark, path, segments, "postings", id, first).select("term", id, "tf"), f"{path}/{name}/postings", settings.buckets)
    voids, n_gone = [_read(spark, path, s.name, "gone", id) for s in segments[first:] if s.n_gone], 0
    if first and voids:
        reduce(DataFrame.unionByName, voids).distinct().write.parquet(f"{path}/{name}/gone")
        n_gone = spark.read.parquet(f"{path}/{name}/gone").count()
    _commit(spark, path, number + 1, settings, [*segments[:first], _measured(spark, path, name, n_gone, id)])
    return load(spark, path)
