"""Saving and loading of tables, index layout on disk, and reuse of saved results."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigo.functions.text import BLANK
from vestigo.operators.refresh import changed_docs, content_hashes, gone_docs
from vestigo.operators.terms import FREQUENT, Index, IndexSettings, counted_terms, document_norms, term_weights

BUCKETS = 256
# Query terms pushed down by name instead of by bucket alone.
FEW_TERMS = 1000

# Working folders of local sessions that name none.
_own_folders: dict[str, str] = {}
# Paths of each scope in force, the innermost last.
_scopes: list[list[str]] = []


def save_table(df: DataFrame, path: str, existing: str = "replace") -> None:
    """Write a table; an existing one is replaced or kept."""
    modes = {"replace": "overwrite", "keep": "ignore"}
    if existing not in modes:
        raise ValueError("existing must be 'replace' or 'keep'")
    df.write.mode(modes[existing]).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def working_folder(spark: SparkSession) -> str:
    """Shared folder the session names for intermediate tables; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="run-")
        folder = _own_folders[app]
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the working folder; the innermost ``scope`` deletes it."""
    path = f"{working_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table written once to the working folder: no later use computes it again.

    Within a ``scope`` the table is deleted at its end; else it stays until the working folder is cleared.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """While it lasts, remember what is made in the working folder; at the end delete it.

    Shared frames are written once and read by all branches of a plan, so run the plan's actions inside. Scopes nest: a
    path belongs to the innermost one. What an action outside still needs must be saved elsewhere.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def term_bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def save_index(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", pattern: str = BLANK,
               stop_words: Iterable[str] = (), buckets: int = BUCKETS) -> Index:
    """Index a collection and write it so that a search reads only the term buckets it needs; return the saved index.

    Terms and norms are derived from the postings just written; the texts are read once more for their hashes. The
    settings are saved with the index.
    """
    settings = IndexSettings(buckets, pattern, tuple(sorted(set(stop_words))), id, text)
    write_postings(counted_terms(docs, id, text, pattern, stop_words), f"{path}/postings", buckets)
    return _finish_index(docs, path, settings)


def write_postings(postings: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Postings partitioned by term bucket and sorted by term within files.

    The rebalance hint lets Spark split the bucket of a very common term over several tasks and merge small ones.
    """
    rows = postings.withColumn("bucket", term_bucket(buckets)).hint("rebalance", "bucket")
    rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _finish_index(docs: DataFrame, path: str, settings: IndexSettings) -> Index:
    spark = docs.sparkSession
    id, text, buckets = settings.id, settings.text, settings.buckets
    postings = spark.read.parquet(f"{path}/postings")
    write_postings(term_weights(postings, docs), f"{path}/terms", buckets)
    norms = document_norms(postings, spark.read.parquet(f"{path}/terms"), docs, id, FREQUENT)
    norms.write.mode("overwrite").parquet(f"{path}/docs")
    content_hashes(docs, id, text).write.mode("overwrite").parquet(f"{path}/hashes")
    record = spark.createDataFrame([(json.dumps(settings._asdict()),)], "settings string")
    record.coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    return load_index(spark, path)


def refresh_index(old: str, docs: DataFrame, new: str, **expected) -> Index:
    """Write the index of the current documents to ``new``, tokenising only what differs from the index at ``old``.

    Pattern, stop words, buckets and columns are those the old index was built with; settings given here must agree
    with them, else ``ValueError``. The differing ids are written first, so that Spark plans the joins below with their true size.
    """
    spark = docs.sparkSession
    settings = agreed(read_settings(spark, old), **expected)
    buckets, pattern, stop_words, id, text = settings
    stored = spark.read.parquet(f"{old}/hashes")
    gone_docs(docs, stored, id, text).write.mode("overwrite").parquet(f"{new}/gone")
    changed_docs(docs, stored, id, text).select(id, text).write.mode("overwrite").parquet(f"{new}/changed")
    kept = (spark.read.parquet(f"{old}/postings").select("term", id, "tf")
            .join(spark.read.parquet(f"{new}/gone"), id, "left_anti"))
    fresh = counted_terms(spark.read.parquet(f"{new}/changed"), id, text, pattern, stop_words)
    write_postings(kept.unionByName(fresh), f"{new}/postings", buckets)
    return _finish_index(docs, new, settings)


def read_settings(spark: SparkSession, path: str) -> IndexSettings:
    record = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    return IndexSettings(**record | {"stop_words": tuple(record["stop_words"])})


def agreed(settings: IndexSettings, **expected) -> IndexSettings:
    """The settings of a saved index, when those expected of it agree."""
    if "stop_words" in expected:
        expected["stop_words"] = tuple(sorted(set(expected["stop_words"])))
    for name, value in expected.items():
        if getattr(settings, name) != value:
            raise ValueError(f"the index was built with {name}={getattr(settings, name)!r}, not {value!r}")
    return settings


def load_index(spark: SparkSession, path: str, **expected) -> Index:
    """A saved index with its settings; settings given here must agree with them, else ``ValueError``."""
    settings = agreed(read_settings(spark, path), **expected)
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "docs")], settings)


def only_terms(index: Index, terms: DataFrame, **expected) -> Index:
    """A saved index cut down to query terms: to their buckets, and to the terms themselves while they are few.

    At most ``buckets`` numbers and FEW_TERMS terms are brought to the driver. Files are sorted by term, so a filter
    on few terms skips most row groups.
    """
    if index.settings is None:
        raise ValueError("the index was not loaded with its settings")
    buckets = agreed(index.settings, **expected).buckets
    wanted = [r["bucket"] for r in terms.select(term_bucket(buckets).alias("bucket")).distinct().collect()]
    keep = F.col("bucket").isin(wanted)
    few = terms.select("term").distinct().limit(FEW_TERMS + 1).collect()
    if len(few) <= FEW_TERMS:
        keep &= F.col("term").isin([r["term"] for r in few])
    return index._replace(postings=index.postings.filter(keep).drop("bucket"), terms=index.terms.filter(keep).drop("bucket"))


def fingerprint(df: DataFrame) -> str:
    """Order-free digest of a table's rows: their number and two sums of row hashes."""
    return _told(df.schema, df.select(*_row_hashes(df)).agg(*_sums()).first())


def _row_hashes(df: DataFrame) -> list:
    names = sorted(df.columns)
    return [F.xxhash64(*names).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit("second"), *names).cast("decimal(38,0)").alias("b"),
            F.lit(1).cast("long").alias("n")]


def _sums() -> list:
    return [F.sum(c).alias(c) for c in ("n", "a", "b")]


def _told(schema, sums) -> str:
    types = ",".join(f"{n}:{schema[n].dataType.simpleString()}" for n in sorted(schema.names))
    n, a, b = sums["n"] or 0, sums["a"], sums["b"]
    return hashlib.sha256(f"{types}|{n}|{a}|{b}".encode()).hexdigest()


def saved_fingerprint(spark: SparkSession, path: str, store: str) -> str:
    """``fingerprint`` of the parquet table at a path, from digests kept for each of its files.

    ``store`` holds a row (path, length, modified, n, a, b) for each file ever read. A file is read again only when
    its path, length or modification time is new, so a table that grew costs its new files, and an unchanged one a listing.
    The sums of files add up to those of the table, whatever files its rows lie in.
    """
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select(
        plain.alias("path"), "length", F.unix_micros("modificationTime").alias("modified"))
    kept = "path string, length bigint, modified bigint, n bigint, a decimal(38,0), b decimal(38,0)"
    known = spark.read.schema(kept).parquet(store) if table_exists(spark, store) else spark.createDataFrame([], kept)
    key = ["path", "length", "modified"]
    new = listed.join(known, key, "left_anti").collect()  # a row for each new file, which Spark's reader lists on the driver too
    if new:
        rows = spark.read.option("basePath", path).parquet(*[r["path"] for r in new])
        of = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("path")
        digests = rows.select(of, *_row_hashes(rows)).groupBy("path").agg(*_sums())
        files = spark.createDataFrame(new, listed.schema)
        zero = F.lit(0).cast("decimal(38,0)")
        files.join(digests, "path", "left").select(
            *key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b")).write.mode("append").parquet(store)
        known = spark.read.schema(kept).parquet(store)
    sums = known.dropDuplicates(key).join(listed, key, "left_semi").agg(*_sums()).first()
    if not sums["n"]:
        sums = {"n": 0, "a": None, "b": None}
    return _told(spark.read.parquet(path).schema, sums)


def reuse_key(steps: str, params: Mapping[str, object], inputs: Mapping[str, DataFrame | str], spark: SparkSession | None = None,
              store: str | None = None) -> str:
    """Key of a result: its steps, all parameters and the content of every input.

    An input is a frame, whose rows are read, or the path of a parquet table, whose files' digests are kept in ``store``;
    both give the same key for the same rows.
    """
    def content(source):
        return saved_fingerprint(spark, source, store) if isinstance(source, str) else fingerprint(source)

    record = {"steps": steps, "params": {k: repr(v) for k, v in sorted(params.items())},
              "inputs": {k: content(df) for k, df in sorted(inputs.items())}}
    return hashlib.sha256(json.dumps(record, sort_keys=True).encode()).hexdigest()


def reuse_or_build(spark: SparkSession, folder: str, name: str, steps: str, params: Mapping[str, object],
                   inputs: Mapping[str, DataFrame | str], build: Callable[[str], None], read: Callable[[str], object]):
    """Read a saved result when steps, parameters and inputs all match, else build, save and read it.

    ``build`` writes to the path it is given; the marker that makes a result valid is written after it. Inputs given as
    paths are compared by their files' digests, kept in the same folder.
    """
    path = f"{folder}/{name}-{reuse_key(steps, params, inputs, spark, f'{folder}/digests')[:32]}"
    if not table_exists(spark, f"{path}/_done"):
        build(f"{path}/data")
        spark.range(1).select(F.lit(steps).alias("steps")).write.mode("overwrite").parquet(f"{path}/_done")
    return read(f"{path}/data")
