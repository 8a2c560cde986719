"""Incremental index refresh: only new and changed documents are tokenised again."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigo.functions.text import BLANK
from vestigo.operators.terms import term_frequencies


def content_hashes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hash) of each document's content."""
    return docs.select(id, _hash(text).alias("hash"))


def _hash(text: str):
    """SHA-256 of a text; a null text has an empty hash, which no text has."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def changed_docs(docs: DataFrame, stored: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that are new or differ from the stored hashes."""
    hashed = docs.withColumn("hash", _hash(text))
    return hashed.join(stored.select(id, "hash"), [id, "hash"], "left_anti").drop("hash")


def gone_docs(docs: DataFrame, stored: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id) of stored documents that vanished or changed, whose old postings no longer hold."""
    return stored.select(id, "hash").join(content_hashes(docs, id, text), [id, "hash"], "left_anti").select(id)


def refresh_postings(postings: DataFrame, stored: DataFrame, docs: DataFrame, id: str = "doc_id", text: str = "text",
                     pattern: str = BLANK, stop_words: Iterable[str] = ()) -> DataFrame:
    """Postings of the current documents from older postings and the hashes stored with them.

    Documents that vanished or changed lose their old postings; new and changed ones are indexed.
    """
    kept = postings.join(gone_docs(docs, stored, id, text), id, "left_anti")
    fresh = term_frequencies(changed_docs(docs, stored, id, text), id, text, pattern, stop_words)
    return kept.select("term", id, "tf").unionByName(fresh)
