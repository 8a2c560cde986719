"""Substring dedup by hashed units: digests grouped globally, the earliest occurrence stays, spans of the rest are named.

Units are lines, paragraphs, or the sentences of each line. A passage copied into the middle of another line shares
whole sentences with its source whatever stands around it, so sentences find it where whole lines do not.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vestigo.llm.common import Remembered, by_batches, frugal
from vestigo.sources.tables import written

#: Words a span must hold. A passage of over 50 words mostly begins and ends inside a sentence; whole sentences of it count.
LEAST_WORDS = 30
#: Units with fewer words are passed over: they repeat by chance. They neither end a run nor count in it.
UNIT_WORDS = 3
#: Sentences with more words are also cut behind words whose MD5 begins with the hexadecimal digit 0, so that a part of a
#: very long one, or of a text without full stops, can be found.
LONG_WORDS = 24
BLANK = r"\x20\x09-\x0D"
PARAGRAPH = re.compile(rf"\n[{BLANK}]*\n")
SENTENCE = re.compile(rf"[^{BLANK}][^\n]*?(?:[.!?](?=[{BLANK}]|\Z)|(?=\n|\Z))")
WORD = re.compile(rf"[^{BLANK}]+")
UNIT_ROWS = "doc_id long, row long, unit long, begin long, stop long, words long, digest long"
_LATEST = 2 ** 63 - 1


def units_of(text: str, by: str = "sentence"):
    """(begin, stop, words) of each unit with words, in order; offsets in characters, from its first word to its last."""
    if by == "sentence":
        for m in SENTENCE.finditer(text):
            words = m.group().encode().lower().split()
            if len(words) <= LONG_WORDS:
                yield m.start(), m.start() + len(m.group().rstrip(" \t\n\v\f\r")), words
            else:
                yield from _cut(m.group(), m.start(), words)
        return
    at, breaks = 0, re.compile("\n") if by == "line" else PARAGRAPH
    for begin, stop in [*(m.span() for m in breaks.finditer(text)), (len(text), len(text))]:
        unit = text[at:begin]
        if words := unit.encode().lower().split():
            whole = unit.rstrip(" \t\n\v\f\r")
            yield at + len(unit) - len(unit.lstrip(" \t\n\v\f\r")), at + len(whole), words
        at = stop


_ends_part = Remembered(lambda word: hashlib.md5(word.encode()).hexdigest()[0] == "0", 1 << 16)


def _cut(sentence: str, at: int, words: list[bytes]):
    first = 0
    places = [m.span() for m in WORD.finditer(sentence)]
    for i, word in enumerate(words):
        if i + 1 == len(words) or _ends_part[word.decode()]:
            yield at + places[first][0], at + places[i][1], words[first:i + 1]
            first = i + 1


def units(docs: DataFrame, by: str = "sentence", least: int = UNIT_WORDS) -> DataFrame:
    """Every unit of at least ``least`` words: its text's id and hash, number among those of its text, offsets, words, and the
    64-bit digest of its words in ASCII lower case. Null and empty texts have none."""
    def work(batch):
        rows: list[tuple] = []
        for i, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            k = 0
            for begin, stop, words in units_of(text.as_py(), by):
                if len(words) >= least:
                    rows.append((i, row, k, begin, stop, len(words), xxhash.xxh64_intdigest(b" ".join(words)) - 2 ** 63))
                    k += 1
                if len(rows) == 50_000:
                    yield _columns(rows)
                    rows = []
        yield _columns(rows)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    return by_batches(narrow.filter("text is not null"), work, UNIT_ROWS)


def _columns(rows):
    return [pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)]


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS, by: str = "sentence", least_unit: int = UNIT_WORDS) -> DataFrame:
    """(doc_id, begin, stop, n_units, n_words, first_doc_id, row): spans to remove, with offsets in the original text.

    A unit repeats when a unit with the same words, in ASCII lower case, occurs earlier: in a document with a smaller id,
    or before it in the same text; rows without an id come last, rows of one id in the order of their texts' hashes. The
    earliest stays. Units that follow each other and all repeat make one span; spans of at least ``least_words`` words
    are returned (1 for all). Units of fewer than ``least_unit`` words are passed over. ``first_doc_id`` is the document
    that keeps the span's first unit. ``row`` is the hash of the text, which tells rows of one id apart; equal rows of one id are
    one document. Null and empty texts have no units; an empty table gives no rows. Digests have 64 bits and are
    compared together with the number of words.
    """
    rows = written(units(docs, by, least_unit), "units")
    rank = F.coalesce("doc_id", F.lit(_LATEST))
    place = F.struct(rank.alias("rank"), "row", "unit")
    firsts = written(rows.groupBy("digest", "words").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
                     .filter("n > 1").select("digest", "words", "first"), "firsts")
    later = (rows.join(firsts, ["digest", "words"]).filter(place > F.col("first"))
             .select("doc_id", "row", "unit", "words", "begin", "stop", F.col("first.rank").alias("rank")))
    at = F.col("unit") - F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("unit"))
    found = (later.dropDuplicates(["doc_id", "row", "unit"]).withColumn("run", at).groupBy("doc_id", "row", "run")
             .agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n_units"),
                  F.sum("words").alias("n_words"), F.min_by("rank", "unit").alias("rank")))
    return found.filter(F.col("n_words") >= least_words).select(
        "doc_id", "begin", "stop", "n_units", "n_words", F.when(F.col("rank") < _LATEST, F.col("rank")).alias("first_doc_id"), "row")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of ``text``; documents without spans, and columns of any names, are unchanged."""
    cuts = spans.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("begin", "stop"))).alias("cuts"))
    cuts = cuts.select(F.struct(F.col("doc_id").alias("doc"), "row", "cuts").alias("of"))
    whole = docs.select(F.struct("*").alias("doc"))
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("of.doc")) & (F.xxhash64("doc.text") == F.col("of.row"))
    joined = whole.join(cuts, same, "left")

    def cut(batches):
        for batch in batches:
            docs_, texts = batch.column(0), []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if spans:
                    edges = [0, *(e for s in spans for e in (s["begin"], s["stop"])), len(text)]
                    text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([docs_, pa.array(texts, pa.string())], ["doc", "text"])

    schema = StructType([whole.schema["doc"], StructField("text", StringType())])
    done = joined.select("doc", F.col("doc.text").alias("text"), F.col("of.cuts").alias("cuts")).mapInArrow(frugal(cut), schema)
    return done.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
