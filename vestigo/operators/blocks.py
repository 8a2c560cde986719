"""Exact best-k matching of a query table against a collection, without pairing them row by row in the plan.

Scores are computed block against block inside tasks, and only the best k candidates per query leave a task. The
smaller side is shipped to all tasks when its measured size allows; otherwise both sides are cut into bounded
blocks and every block of one meets every block of the other in its own group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIP_BYTES = 64 << 20
BLOCK_BYTES = 128 << 20
BATCH_ROWS = 1 << 14
# Candidates each task hands on while all queries go to every task of the collection; with more, queries are split too.
SHIP_ROWS = 1 << 16
# Queries a task scores at a time, and the candidates it then holds.
QUERY_ROWS = 1 << 12
# Entries of one score matrix; two megabytes stay in a core's cache.
CELLS = 1 << 18
# Candidates one task may hold and hand on: queries times k.
HOLD_ROWS = 1 << 22

# (queries, collection rows, best so far) -> iterator of (query numbers, row numbers, scores); larger is better. All pairs
# are in it that can be among the best k of a query.
Scorer = Callable[[object, pa.Table, "BestK"], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]
# All rows of a part -> (queries, best so far) -> iterator as a scorer's. What it makes of the rows serves all their queries.
Whole = Callable[[pa.Table], Callable[[pa.Table, "BestK"], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]


def measure(df: DataFrame, size: Column) -> tuple[int, int]:
    """Rows and bytes of a frame, added up by the tasks."""
    row = df.select((size + F.lit(32)).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def fits(df: DataFrame, size: Column, max_bytes: int = SHIP_BYTES) -> bool:
    """Whether the whole frame is proven to stay within the byte bound."""
    return measure(df, size)[1] <= max_bytes


def fetch_small(df: DataFrame, size: Column, max_bytes: int = SHIP_BYTES,
                max_rows: int = HOLD_ROWS) -> tuple[pa.Table | None, int, int]:
    """A frame as one table when it is within both bounds, else None; and its rows and bytes.

    It is measured before anything is held, so a frame of unknown size takes no memory anywhere.
    """
    rows, total = measure(df, size)
    return (df.toArrow() if rows <= max_rows and total <= max_bytes else None), rows, total


def places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix with few places set."""
    return np.divmod(np.flatnonzero(hit), hit.shape[1])


class BestK:
    """Running best k per query over blocks of scores; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, id_type: pa.DataType):
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.held = pa.table({"q": pa.array([], pa.int64()), "s": pa.array([], pa.float64()),
                              "id": pa.array([], id_type)})
        self.waiting: list[pa.Table] = []
        self.waiting_rows = 0

    def chosen(self, scores: np.ndarray, who: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) numbers of a score matrix, of the queries ``who``, that can be among the best; NaN is no match."""
        if self.k == 0 or not scores.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit = scores >= self.floor[who][:, None]
        if scores.shape[1] > self.k and np.count_nonzero(hit) > 2 * self.k * len(scores):
            cut = np.partition(np.where(np.isnan(scores), -np.inf, scores), -self.k, axis=1)[:, -self.k]
            # k rows of this block reach the cut, so no later row below it can be among the best
            self.floor[who] = np.maximum(self.floor[who], cut)
            hit = scores >= self.floor[who][:, None]
        return places(hit)

    def sifted(self, rough: np.ndarray, reach: Callable, least: Callable, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``chosen`` by rough values (no NaN) of the queries ``who``: ``reach`` gives the rough value that scores from a
        floor on must have, ``least`` the score that a rough value is sure to reach."""
        if self.k == 0 or not rough.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit = rough >= reach(self.floor[who])[:, None]
        if rough.shape[1] > self.k and np.count_nonzero(hit) > 2 * self.k * len(rough):
            cut = np.partition(rough, -self.k, axis=1)[:, -self.k]
            self.floor[who] = np.maximum(self.floor[who], least(cut))
            hit = rough >= reach(self.floor[who])[:, None]
        return places(hit)

    def offer(self, scores: np.ndarray, ids: pa.Array) -> None:
        q, d = self.chosen(scores)
        self.add(q, scores[q, d], ids.take(pa.array(d)))

    def add(self, q: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        if len(q):
            self.waiting.append(pa.table({"q": pa.array(q, pa.int64()), "s": pa.array(scores, pa.float64()), "id": ids}))
            self.waiting_rows += len(q)
            if self.waiting_rows > max(self.k * len(self.floor), 1 << 16):
                self.settle()

    def settle(self) -> pa.Table:
        if self.waiting:
            rows = pa.concat_tables([self.held, *self.waiting]).combine_chunks()
            rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("s", "descending"), ("id", "ascending")]))
            q = rows["q"].to_numpy()
            start = np.searchsorted(q, q, side="left")
            place = np.arange(len(q)) - start
            self.held = rows.filter(pa.array(place < self.k))
            full = place == self.k - 1
            self.floor[q[full]] = np.maximum(self.floor[q[full]], rows["s"].to_numpy()[full])
            self.waiting, self.waiting_rows = [], 0
        return self.held


def dense(scorer: Callable[[object, pa.Table], Iterator[tuple[int, np.ndarray]]]) -> Scorer:
    """A scorer from one that gives whole score matrices [query, row] with their first rows."""
    def pairs(queries, rows, best):
        for first, scores in scorer(queries, rows):
            q, d = best.chosen(scores)
            yield q, first + d, scores[q, d]
    return pairs


def grid(cells: int, q_least: int, c_least: int, q_bytes: float, c_bytes: float) -> tuple[int, int]:
    """Parts of queries and of the collection, at least ``cells`` together and each no fewer than given, for the fewest bytes:
    ``q_bytes`` are sent for each part of the collection, ``c_bytes`` for each part of the queries."""
    c = max(c_least, min(cells, round(float(np.sqrt(cells * max(c_bytes, 1) / max(q_bytes, 1))))), 1)
    q = max(q_least, -(-cells // c))
    return q, max(c_least, -(-cells // q))


def best_k(queries: DataFrame, corpus: DataFrame, k: int, scorer: Scorer, *, query_id: str, id: str,
           query_size: Column, corpus_size: Column, ship_bytes: int = SHIP_BYTES,
           block_bytes: int = BLOCK_BYTES, hold_rows: int = HOLD_ROWS, prepare: Callable[[pa.Table], object] | None = None,
           at_once: int = QUERY_ROWS, whole: Whole | None = None) -> DataFrame:
    """Candidates ``(query_id, id, score)`` that contain the exact best k rows of the collection for each query.

    ``query_size`` and ``corpus_size`` give the bytes of a row. Few queries are shipped to all tasks of the collection, and
    per query there may be up to k candidates from each; ``ranking.top_k`` merges them. Else a small collection is shipped to
    the tasks of the queries, or both sides are cut into a grid: a query then has k candidates, or k from each part of the
    collection, however many tasks there are. A task scores ``at_once`` queries at a time. What ``prepare`` makes of a
    table of queries, once for all rows they meet, goes to the scorer in its place. Where a task holds all rows of its part,
    ``whole`` finds the pairs, if given, and the scorer is left out.
    """
    spark = queries.sparkSession
    schema = (f"{query_id} {queries.schema[query_id].dataType.simpleString()}, "
              f"{id} {corpus.schema[id].dataType.simpleString()}, score double")
    most = hold_rows // max(k, 1)
    at_once = max(1, min(at_once, most))

    def told(q: pa.Table, best: BestK) -> Iterator[pa.RecordBatch]:
        held = best.settle()
        out = pa.table({query_id: q.column(query_id).combine_chunks().take(held["q"].combine_chunks()), id: held["id"], "score": held["s"]})
        return iter(out.to_batches(BATCH_ROWS))

    def match(q: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        ready = prepare(q) if prepare else q
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held_ids = rows.column(id).combine_chunks()
            best = best or BestK(q.num_rows, k, held_ids.type)
            for who, at, scores in scorer(ready, rows, best):
                best.add(who, scores, held_ids.take(pa.array(at)))
        if best is not None:
            yield from told(q, best)

    def finder(rows: pa.Table) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
        """What finds the best rows of a part for tables of queries."""
        if whole is None:
            batches = rows.to_batches(BATCH_ROWS)

            def turn(q: pa.Table) -> Iterator[pa.RecordBatch]:
                return match(q, iter(batches))
        else:
            ids, search = rows.column(id).combine_chunks(), whole(rows)

            def turn(q: pa.Table) -> Iterator[pa.RecordBatch]:
                best = BestK(q.num_rows, k, ids.type)
                for who, at, scores in search(q, best):
                    best.add(who, scores, ids.take(pa.array(at)))
                return told(q, best)

        def by_turns(q: pa.Table) -> Iterator[pa.RecordBatch]:
            for first in range(0, q.num_rows, at_once):
                yield from turn(q.slice(first, at_once).combine_chunks())

        return by_turns

    query_rows, query_bytes = measure(queries, query_size)
    if query_rows <= min(most, max(SHIP_ROWS // max(k, 1), 1)) and query_bytes <= ship_bytes:
        shipped = spark.sparkContext.broadcast(pack(queries.toArrow()))
        return corpus.mapInArrow(lambda batches: match(unpack(shipped.value), batches), schema)

    tasks = 3 * spark.sparkContext.defaultParallelism
    corpus_bytes = measure(corpus, corpus_size)[1]
    if corpus_bytes <= ship_bytes:
        shipped_rows = spark.sparkContext.broadcast(pack(corpus.toArrow()))

        def search_all(batches):
            find = None
            for q in gathered(batches, at_once):
                find = find or finder(unpack(shipped_rows.value).combine_chunks())
                yield from find(q)

        return queries.repartition(tasks).mapInArrow(search_all, schema)

    # a block of queries is held with the candidates it meets: their bytes are part of what a part of the collection costs
    q_parts, c_parts = grid(tasks, max(-(-query_bytes // ship_bytes), -(-query_rows // max(most, 1))), -(-corpus_bytes // block_bytes),
                            query_bytes + 32.0 * k * query_rows, corpus_bytes)
    # columns named anew: cogroup loses those that both sides take from one frame
    keys = cell_keys(spark, q_parts * c_parts)
    named = F.array(*[F.array(*[_long(key) for key in keys[at:at + c_parts]]) for at in range(0, len(keys), c_parts)])
    left = (queries.select(*[F.col(name).alias(name) for name in queries.columns])
            .withColumn("_cell", F.explode(F.get(named, F.pmod(F.xxhash64(query_id), F.lit(q_parts)).cast("int")))))
    right = corpus.withColumn("_cell", F.explode(F.transform(named, lambda row: F.get(row, F.pmod(F.xxhash64(id), F.lit(c_parts)).cast("int")))))

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        found = list(finder(c.combine_chunks())(q)) if q.num_rows and c.num_rows else []
        if found:
            return pa.Table.from_batches(found)
        return pa.table({query_id: pa.array([], q.schema.field(query_id).type),
                         id: pa.array([], c.schema.field(id).type), "score": pa.array([], pa.float64())})

    return left.groupBy("_cell").cogroup(right.groupBy("_cell")).applyInArrow(cell, schema)


def cell_keys(spark, cells: int) -> list[int]:
    """Different keys for so many groups, which a shuffle by key deals to all its partitions in turn."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = spark.range(16 * max(cells, parts)).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("part")).collect()
    held = [[] for _ in range(parts)]
    for row in drawn:
        held[row["part"]].append(row["id"])
    rounds = sorted((turn, part) for part, ids in enumerate(held) for turn in range(len(ids)))
    return [held[part][turn] for turn, part in rounds[:cells]]


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of at least so many rows, but for the last."""
    held = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.BufferReader(data)).read_all()
