"""Exact nearest neighbours in a metric space without scoring all pairs.

Pivots, a bounded sample of the items, cut the items into cells of the nearest pivot; a cell's radius is its farthest item's
distance from the pivot. A query is first scored in its nearest cells, as many as hold k items. The k-th distance found
there bounds the answer: by the triangle inequality a cell whose pivot is farther than that bound plus the cell's radius
holds no better item, and is not scored. Cells are cut into blocks of bounded size; a block's items are held in a task while
the queries stream past. Pruning pays on vectors with clusters; without any it scores all pairs, block by block.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigo.operators.blocks import BestK
from vestigo.operators.distances import distance_scores, matrix
from vestigo.operators.ranking import top_k
from vestigo.schemas import require
from vestigo.sources.tables import written

METRICS = ("l2", "l1", "cosine")
#: Items aimed at in a cell, most pivots, most items of a block, rows handled at a time.
CELL, PIVOTS, BLOCK, ROWS = 1024, 1024, 4096, 1024
#: Relative slack of distances to pivots, for rounding.
SLACK = 1e-7


class Pruned(NamedTuple):
    """Ranked neighbours (query_id, id, distance, rank); the pairs that were scored, as one row; the number of all pairs."""

    found: DataFrame
    scored: DataFrame
    all_pairs: int


class Cells(NamedTuple):
    points: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    parts: np.ndarray


def _geometry(v: np.ndarray, metric: str) -> np.ndarray:
    """Vectors in whose space the metric is a distance: cosine is a chord between unit vectors."""
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True)) if metric == "cosine" else v


def _to_pivots(v: np.ndarray, points: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l1":
        far = np.zeros((len(v), len(points)))
        for j in range(points.shape[1]):
            far += np.abs(v[:, j][:, None] - points[:, j][None, :])
        return far
    square = (v * v).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (v @ points.T)
    return np.sqrt(np.maximum(square, 0))


def _bound(distance: np.ndarray, metric: str, unit: float) -> np.ndarray:
    """Largest distance in the metric's space of items that may tie with ``distance`` when it was rounded to ``unit``."""
    return np.sqrt(2 * np.maximum(distance + unit, 0)) if metric == "cosine" else distance + unit


def usable(vector: str, metric: str):
    c = F.col(vector)
    good = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e150)))
    return good & F.exists(c, lambda x: F.abs(x) > F.lit(1e-150)) if metric == "cosine" else good


def _mapped(frame: DataFrame, work, schema: str) -> DataFrame:
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for columns in work(batch.slice(at, ROWS)):
                    yield pa.RecordBatch.from_arrays(columns, names)

    return frame.mapInArrow(run, schema)


def _homes(items: DataFrame, points, metric: str, parts=None) -> DataFrame:
    """(cell, far) of each item, or with ``parts`` (cell, block, item, v)."""
    spots = items.sparkSession.sparkContext.broadcast((points, parts))
    kind = items.schema["item"].dataType.simpleString()

    def work(batch):
        points, parts = spots.value
        far = _to_pivots(_geometry(matrix(batch.column(2)), metric), points, metric)
        home = far.argmin(axis=1)
        if parts is None:
            yield [pa.array(home, pa.int32()), pa.array(far[np.arange(len(far)), home])]
        else:
            block = batch.column(1).to_numpy(zero_copy_only=False) % parts[home]
            yield [pa.array(home, pa.int32()), pa.array(block, pa.int32()), batch.column(0), batch.column(2)]

    return _mapped(items, work, "cell int, far double" if parts is None else f"cell int, block int, item {kind}, v array<double>")


def _visits(asked: DataFrame, cells: Cells, metric: str, k: int, unit: float, later: bool) -> DataFrame:
    """(cell, block, query, v, most, n) for each block a query has to meet: of its nearest cells, or of those its bound ``most``
    leaves."""
    spots = asked.sparkSession.sparkContext.broadcast(cells)
    kind = asked.schema["query"].dataType.simpleString()

    def work(batch):
        cells = spots.value
        far = _to_pivots(_geometry(matrix(batch.column(1)), metric), cells.points, metric)
        order = np.argsort(far, axis=1, kind="stable")
        before = np.cumsum(cells.sizes[order], axis=1) - cells.sizes[order]
        wanted = np.zeros(far.shape, bool)
        np.put_along_axis(wanted, order, before < k, axis=1)
        bound = batch.column(2) if later else pa.nulls(len(far), pa.float64())
        if later:
            most = bound.to_numpy(zero_copy_only=False).astype(float)
            reach = np.where(np.isnan(most), np.inf, _bound(most, metric, unit))
            least = far * (1 - SLACK) - cells.radius * (1 + SLACK) - SLACK
            wanted = ~wanted & (least <= reach[:, None])
        wanted &= cells.sizes > 0
        who, cell = np.nonzero(wanted)
        times = cells.parts[cell]
        who, cell = np.repeat(who, times), np.repeat(cell, times)
        block = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
        n = np.where(block == 0, cells.sizes[cell], 0)
        for at in range(0, len(who), ROWS):
            some = slice(at, at + ROWS)
            took = pa.array(who[some])
            yield [pa.array(cell[some], pa.int32()), pa.array(block[some], pa.int32()), batch.column(0).take(took),
                   batch.column(1).take(took), bound.take(took), pa.array(n[some], pa.int64())]

    return _mapped(asked, work, f"cell int, block int, query {kind}, v array<double>, most double, n long")


def _met(items: DataFrame, visits: DataFrame, metric: str, k: int, digits: int | None) -> DataFrame:
    """(query, item, score): for each query and block the best k items, none farther than the query's bound; scores are negated
    distances. Without the bound a block of k items or fewer would hand on every pair."""
    item, query = items.schema["item"].dataType.simpleString(), visits.schema["query"].dataType.simpleString()
    left = items.select("cell", "block", F.lit(0).alias("kind"), "item", F.lit(None).cast(query).alias("query"), "v",
                        F.lit(None).cast("double").alias("most"))
    right = visits.select("cell", "block", F.lit(1).alias("kind"), F.lit(None).cast(item).alias("item"), "query", "v", "most")

    def run(batches):
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            starts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(axis=1)])
            for at, to in zip(starts, np.r_[starts[1:], batch.num_rows]):
                if key != tuple(where[at][:2]):
                    key, held = tuple(where[at][:2]), []
                part = pa.Table.from_batches([batch.slice(at, to - at)])
                if where[at][2] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                held = [pa.concat_tables(held).combine_chunks()]
                ids = held[0]["item"].combine_chunks()
                for first in range(0, part.num_rows, ROWS):
                    some = part.slice(first, ROWS)
                    best = BestK(some.num_rows, k, ids.type)
                    most = some["most"].to_numpy().astype(float)
                    best.floor = np.where(np.isnan(most), -np.inf, -most - SLACK * (1 + most))
                    for begin, scores in distance_scores(some["v"], held[0]["v"], metric, k, digits):
                        best.offer(scores, ids.slice(begin, scores.shape[1]))
                    rows = best.settle()
                    out = pa.table({"query": some["query"].combine_chunks().take(rows["q"].combine_chunks()), "item": rows["id"], "score": rows["s"]})
                    yield from out.combine_chunks().to_batches()

    both = left.unionByName(right).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    return both.mapInArrow(run, f"query {query}, item {item}, score double")


def nearest_pruned(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id: str = "id", vector: str = "vector",
                   digits: int | None = None, cell: int = CELL, pivots: int = PIVOTS, block: int = BLOCK) -> Pruned:
    """``distances.nearest`` with cells that cannot hold a neighbour left out; ``metric`` is l2, l1 or cosine.

    Vectors that are null, empty or hold null or non-finite entries (for cosine also zero vectors) take no part. The driver
    holds at most ``pivots`` vectors and a size and a radius for each.
    """
    require(corpus, id, vectors=(vector,))
    require(queries, "query_id", vectors=(vector,))
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    place = F.pmod(F.xxhash64(id), F.lit(1 << 30)).cast("long")
    items = written(corpus.filter(usable(vector, metric)).select(
        F.col(id).alias("item"), place.alias("place"), F.col(vector).cast("array<double>").alias("v")), "items")
    asked = written(queries.filter(usable(vector, metric)).select(
        F.col("query_id").alias("query"), F.col(vector).cast("array<double>").alias("v")), "queries")
    n = items.count()
    chosen = items.orderBy("place", "item").limit(min(pivots, max(1, math.ceil(n / cell)))).select("v").collect()
    points = _geometry(np.array([r["v"] for r in chosen], float), metric) if chosen else np.zeros((1, asked.select(F.max(F.size("v"))).first()[0] or 1))
    radius, sizes = np.zeros(len(points)), np.zeros(len(points), np.int64)
    for r in _homes(items, points, metric).groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], sizes[r["cell"]] = r["far"], r["n"]
    cells = Cells(points, radius, sizes, np.maximum(1, -(-sizes // block)))
    placed = _homes(items, points, metric, cells.parts)
    unit = 0.0 if digits is None else 10.0 ** -digits
    order, names = [("score", "descending"), ("item", "ascending")], ["query", "item", "score"]
    first = written(_visits(asked, cells, metric, k, unit, False), "visits")
    ahead = written(_met(placed, first, metric, k, digits), "ahead")
    floor = top_k(ahead, k, order, ["query"]).filter(F.col("rank") == k).select("query", (F.lit(0.0) - F.col("score")).alias("most"))
    bounded = asked.join(floor.withColumnRenamed("query", "q"), F.col("query").eqNullSafe(F.col("q")), "left").select("query", "v", "most")
    second = written(_visits(bounded, cells, metric, k, unit, True), "visits")
    every = ahead.unionByName(_met(placed, second, metric, k, digits)).select(*names)
    ranked = top_k(every.select(F.col("query").alias("query_id"), F.col("item").alias(id), (F.lit(0.0) - F.col("score")).alias("distance")),
                   k, [("distance", "ascending"), (id, "ascending")], ["query_id"])
    pairs = first.select("n").unionByName(second.select("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    return Pruned(ranked, pairs, n * asked.count())
