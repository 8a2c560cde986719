"""Mixing sources to target weights: repetition rates from token totals, whole copies plus one hashed draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vestigo.llm.common import unused
from vestigo.sources.tables import written

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words between ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Add ``weight``: the weights in turn, by code point of the source, null last.

    Ranks come from range partitions: each counts its rows, and only those counts, one per partition, meet in one place.
    """
    parts = written(sources.repartitionByRange(F.col("source").asc_nulls_last())
                    .withColumn("part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    return parts.join(before, "part").withColumn("weight", picked).drop("part", "before")


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Add ``target`` to (source, source_size, weight).

    The targets share ``share`` times all sizes by weight, each at most ``most`` times its source's size; what is
    over goes to the others by weight until none is above. Each round fixes the sources that are at their limit; the
    driver sees three sums a round, and there are as many rounds as sources are fixed in at different times.
    """
    sources = written(sources.withColumn("most", F.col("source_size") * F.lit(float(most))), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, state = 0.0, None
    while True:
        fixed = F.col("weight") * F.lit(level) >= F.col("most")
        got = sources.agg(F.coalesce(F.sum(F.when(fixed, F.col("most"))), F.lit(0.0)),
                          F.coalesce(F.sum(F.when(~fixed, F.col("weight"))), F.lit(0.0)), F.count(F.when(fixed, 1))).first()
        if got == state or not got[1]:
            break
        state, level = got, (share * total - got[0]) / got[1]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("most"))).drop("most")


def draw(id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone: 48 bits of an MD5 digest."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def rates(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
          text: str = "text", source: str = "source") -> DataFrame:
    """(source, source_size, weight, target, rate), one row per source, null included.

    Null texts and texts of blanks have size 0; a source without words has target and rate 0.
    """
    return _rates_of(docs.select(F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")),
                     weights, share, most)


def _rates_of(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return written(targets(cycled_weights(sums, weights), share, most).withColumn("rate", rate), "rates")


def with_copies(docs: DataFrame, table: DataFrame, seed: str = SEED, id: str = "doc_id", source: str = "source",
                name: str = "_mix") -> DataFrame:
    """``docs`` with a struct column ``name`` (source_size, weight, target, copies), which must not be one of its own.

    Each document is taken floor(rate) times, and once more when its draw is below the rest, so never more than
    ceil(``most``) times. Repeated rows of an id draw alike, rows without an id draw as "null".
    """
    of = unused(docs, "side")
    side = table.select(F.struct("source", "source_size", "weight", "target", "rate").alias(of))
    whole = F.floor(f"{of}.rate")
    copies = (whole + F.when(draw(F.col(id), seed) < F.col(f"{of}.rate") - whole, 1).otherwise(0)).cast("long")
    joined = docs.join(side, F.col(source).cast("string").eqNullSafe(F.col(f"{of}.source")))
    return joined.withColumn(name, F.struct(f"{of}.source_size", f"{of}.weight", f"{of}.target", copies.alias("copies"))).drop(of)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, source, size, source_size, weight, target, copies) of every row; an empty table gives no rows."""
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                               word_count(F.col("text")).alias("size")), "sizes")
    return with_copies(rows, _rates_of(rows, **settings)).select("doc_id", "source", "size", "_mix.*")


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, copies next to each other, with the columns of ``docs``, of any names."""
    name, copy = unused(docs, "mix"), unused(docs, "copy")
    rows = with_copies(docs, rates(docs, **settings), name=name).filter(F.col(f"{name}.copies") > 0)
    each = F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies").cast("int")))
    return rows.withColumn(copy, each).select(*[F.col(f"`{c}`") for c in docs.columns])
