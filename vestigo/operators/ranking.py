"""Filters, sorting and top-k over ranked rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

Order = Sequence[tuple[str, str]]

# Above this many estimated candidates for one group, its top k is merged in two levels.
MERGE_ROWS = 50_000_000
SALTS = 256
# Largest rank for which Spark limits the groups of a window before the shuffle, its default.
WINDOW_CUT = 1000
# Rows a task holds while it cuts groups.
HOLD_ROWS = 1 << 20


def _keys(order: Order) -> list[Column]:
    keys = []
    for name, direction in order:
        if direction == "ascending":
            keys.append(F.col(name).asc_nulls_last())
        elif direction == "descending":
            keys.append(F.col(name).desc_nulls_last())
        else:
            raise ValueError(f"direction must be 'ascending' or 'descending', not {direction!r}")
    return keys


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate holds."""
    return df.filter(predicate)


def sort_by_distance(df: DataFrame, direction: str = "ascending", distance: str = "distance", id: str = "id") -> DataFrame:
    """All rows by distance, ties by ascending id, null distances last."""
    return df.orderBy(*_keys([(distance, direction), (id, "ascending")]))


def in_top(df: DataFrame, top: DataFrame, id: str = "id") -> DataFrame:
    """Rows whose id occurs in the top list; repeated rows survive, repeated list entries do not multiply."""
    return df.join(top.select(id), id, "left_semi")


def scored(df: DataFrame, score: str = "score") -> DataFrame:
    """Rows with a usable score: neither null nor NaN."""
    return df.filter(F.col(score).isNotNull() & ~F.isnan(score))


def cut_in_tasks(df: DataFrame, k: int, order: Order, per: Sequence[str], hold_rows: int = HOLD_ROWS) -> DataFrame:
    """Rows that hold the first k of every group: tasks keep the best k of each group they meet, at any k.

    A task sorts what it holds whenever that has doubled, and hands on what it holds when groups times k exceed
    ``hold_rows``, so its memory is bounded whatever the number of groups. Columns to order by must have a plain order (numbers,
    strings, dates); with others the frame is returned as it is.
    """
    by = [n for n, _ in order]
    if any(isinstance(df.schema[n].dataType, (ArrayType, StructType, MapType)) for n in [*by, *per]) or k == 0:
        return df
    schema = df.schema

    def best(table: pa.Table) -> pa.Table:
        group = np.zeros(table.num_rows, np.int64)
        for name in per:
            code = pc.dictionary_encode(table[name].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            group = np.unique(np.stack([group, code.astype(np.int64)]), axis=1, return_inverse=True)[1].reshape(-1)
        keys, names = {"g": pa.array(group)}, [("g", "ascending")]
        for i, (name, direction) in enumerate(order):
            column = table[name].combine_chunks()
            if direction == "descending" and pa.types.is_floating(column.type):  # Spark has NaN above all numbers
                keys[f"n{i}"] = pc.fill_null(pc.is_nan(column), False).cast(pa.int8())
                names.append((f"n{i}", "descending"))
            keys[f"k{i}"] = column
            names.append((f"k{i}", direction))
        rows = pc.sort_indices(pa.table(keys), names, null_placement="at_end").to_numpy()
        ordered = group[rows]
        place = np.arange(len(rows)) - np.searchsorted(ordered, ordered, side="left")
        return table.take(pa.array(rows[place < k]))

    def run(batches):
        held, rows, settled = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                rows += batch.num_rows
                if rows > max(2 * settled, 1 << 16):
                    held = [best(pa.concat_tables(held))]
                    rows = settled = held[0].num_rows
                    if settled > hold_rows:
                        yield from held[0].to_batches()
                        held, rows, settled = [], 0, 0
        if held:
            yield from best(pa.concat_tables(held)).to_batches()

    return df.mapInArrow(run, schema)


def top_k(df: DataFrame, k: int, order: Order, per: Sequence[str] = (), rank: str | None = "rank",
          levels: int | None = None) -> DataFrame:
    """First k rows by ``order``, over everything or per group; the last order column must break all ties.

    Every task forwards at most k rows, so the merge sees k rows per task; with groups Spark does so up to
    k = 1000 (spark.sql.optimizer.windowGroupLimitThreshold), and ``cut_in_tasks`` beyond. When that could still be
    many rows for one merging task, groups of tasks are merged first; both ways give the same rows.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    keys = _keys(order)
    if levels is None:
        tasks = 100 * df.sparkSession.sparkContext.defaultParallelism
        levels = 2 if k * tasks > MERGE_ROWS else 1
    if per and k > WINDOW_CUT:
        df = cut_in_tasks(df, k, order, per)
    if levels == 2:
        salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
        within = Window.partitionBy(*per, "_salt").orderBy(*keys)
        df = (df.withColumn("_salt", salt).withColumn("_n", F.row_number().over(within))
              .filter(F.col("_n") <= k).drop("_n", "_salt"))
    place = rank or "_rank"
    if per:
        window = Window.partitionBy(*per).orderBy(*keys)
    else:
        # ranking the k rows also keeps later projections from slipping under the limit, which would turn the heaps
        # into a sort of the whole frame
        df, window = df.orderBy(*keys).limit(k), Window.orderBy(*keys)
    best = df.withColumn(place, F.row_number().over(window)).filter(F.col(place) <= k)
    return best if rank else best.drop(place)


def merge_top(lists: Sequence[DataFrame], k: int, order: Order, per: Sequence[str] = (),
              rank: str | None = "rank") -> DataFrame:
    """Top k of several ranked lists taken together; a row in two lists counts twice."""
    return top_k(union_all(lists), k, order, per, rank)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    first, *rest = frames
    for other in rest:
        first = first.unionByName(other)
    return first


def ids(df: DataFrame, id: str = "id", rank: str = "rank") -> DataFrame:
    """Ids alone, in rank order when the frame has ranks."""
    if rank in df.columns:
        return df.orderBy(rank).select(id)
    return df.select(id)
