"""Readers: documents, images, precomputed descriptors, catalog files, object listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigo.functions.text import base_name
from vestigo.schemas import DESCRIPTIONS, GROUND_TRUTH, STOP_WORDS, XML_DOCUMENT, require

TEXT, IMAGE, FEATURE, VIDEO = "TEXT", "IMAGE", "FEATURE", "VIDEO"


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Read a collection by input kind."""
    if not path:
        raise ValueError("a path is needed")
    if kind == TEXT:
        return read_documents(spark, path)
    if kind == IMAGE:
        return read_images(spark, path)
    if kind == FEATURE:
        return read_features(spark, path)
    if kind == VIDEO:
        raise NotImplementedError("video is not supported")
    raise ValueError(f"unknown input kind {kind!r}")


def read_documents(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """XML documents, one file or all ``.xml`` files below a folder:
    (doc_id, name, cat, text, images array<struct<id, name, sectnum, path>>, path)."""
    reader = (spark.read.format("xml").schema(XML_DOCUMENT).option("rowTag", "document").option("encoding", encoding)
              .option("mode", "FAILFAST"))
    if not path.lower().endswith(".xml"):
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml")
    images = F.transform("imageset.image", lambda i: F.struct(
        i["_id"].alias("id"), i["_name"].alias("name"), i["_sectnum"].alias("sectnum"), i["_VALUE"].alias("path")))
    return reader.load(path).select(
        F.col("_id").alias("doc_id"), F.col("_name").alias("name"), F.col("_cat").alias("cat"), "text",
        F.coalesce(images, F.array().cast("array<struct<id:string,name:string,sectnum:string,path:string>>")).alias("images"),
        F.col("_metadata.file_path").alias("path"))


def read_images(spark: SparkSession, path: str, suffix: str = ".jpg") -> DataFrame:
    """Image files, one file or all below a folder: (id, path, modificationTime, length, content)."""
    files = _files(spark, path, suffix)
    return files.select(base_name("path").alias("id"), "path", "modificationTime", "length", "content")


def read_features(spark: SparkSession, path: str, format: str = "parquet", id: str = "id",
                  descriptors: str = "descriptors") -> DataFrame:
    """Precomputed local descriptors in long form (id, pos, vector).

    Accepts nested rows (id, descriptors array<array>) and rows already in long form; a nested file set without
    an id column takes the file's base name as id. JSON is read with the nested schema.
    """
    reader = spark.read.format(format).option("recursiveFileLookup", "true")
    if format == "json":
        reader = reader.schema(f"{id} string, {descriptors} array<array<double>>")
    rows = reader.load(path)
    if {"pos", "vector"} <= set(rows.columns):
        return require(rows, id, "pos", vectors=("vector",)).select(F.col(id).alias("id"), "pos", "vector")
    require(rows, descriptors)
    name = base_name(F.col("_metadata.file_path"))
    key = F.coalesce(F.col(id).cast("string"), name) if id in rows.columns else name
    return rows.select(key.alias("id"), F.posexplode(descriptors).alias("pos", "vector"))


def queries_from(df: DataFrame, ids: Sequence, id: str = "id") -> DataFrame:
    """Query rows picked from a collection by id, renamed to ``query_id``."""
    return df.filter(F.col(id).isin(list(ids))).withColumnRenamed(id, "query_id")


def list_objects(spark: SparkSession, prefix: str, extension: str = "") -> DataFrame:
    """(path, length) of all objects below a prefix with that suffix, any suffix when empty; contents stay unread."""
    return _files(spark, prefix, extension).select("path", "length")


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if not (suffix and path.lower().endswith(suffix)):
        reader = reader.option("recursiveFileLookup", "true")
        if suffix:
            reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.load(path)


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a list with one word per line, each word once."""
    words = spark.read.schema(STOP_WORDS).text(path).select(F.trim("word").alias("word"))
    return words.filter("word <> ''").distinct()


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, category, text) of a tab-separated description catalog."""
    return spark.read.schema(DESCRIPTIONS).option("sep", "\t").option("quote", "").csv(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, image_id, category) of a tab-separated pair list."""
    return spark.read.schema(GROUND_TRUTH).option("sep", "\t").option("quote", "").csv(path)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """(category, name) of a list file: the line number, from 1, is the category code.

    A category list is one small file; it is read as one row so that line numbers are certain.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")
    return whole.select(F.posexplode(lines).alias("at", "name")).select(
        (F.col("at") + 1).alias("category"), F.trim("name").alias("name"))



def spread(df: DataFrame, key: str) -> DataFrame:
    """A freshly read frame cut into more tasks by key when its splits are at most half the cores.

    A split without the start of a row group is empty, so few splits keep most cores idle in per-row work. A frame of
    many splits is returned as it is and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df.rdd.getNumPartitions() <= cores:
        return df.repartition(cores, key)
    return df
