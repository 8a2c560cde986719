"""Near-duplicate vectors: an exact range join in a metric space.

Cosine c of unit vectors is a distance of sqrt(2 - 2c). Pivots cut the vectors into cells of the nearest pivot. By the
triangle inequality a vector within t of one of cell i lies within t plus the cell's radius of its pivot, and no more
than 2t farther from it than from its own pivot; only such vectors are copied to cell i, and only from cells of higher
number, so that each pair meets in one cell. A cell is cut into blocks of bounded size; a block is held in memory while
the rest of its cell and the copies stream past, and yields counts and a forest of links, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigo.llm.common import by_batches, frugal, longs
from vestigo.llm.components import components
from vestigo.sources.tables import written

COSINE = 0.95
#: Vectors aimed at in a cell, most pivots kept, and most vectors of a block.
CELL, PIVOTS, BLOCK = 2048, 4096, 1024
ROWS = 4096
#: Slack of the geometric bounds for rounding; pairs are decided by their cosine alone.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, first by their largest entry so that squares stay finite."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def usable(column: str):
    """Vectors that are not null or empty, and have finite components, not all of them zero."""
    c = F.col(column)
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & (F.size(c) > 0) & good & F.exists(c, lambda x: x != 0)


def _placed(nodes: DataFrame, pivots: np.ndarray, radius: np.ndarray | None, reach: float, blocks: np.ndarray | None):
    """Rows of each cell and block. Without radii: (cell, far) of every node; else (cell, block, kind, node, w, v)."""
    spots = nodes.sparkSession.sparkContext.broadcast((pivots, radius, blocks))

    def measured(batch):
        points, most, parts = spots.value
        v = _matrix(batch.column(2))
        for at in range(0, len(v), ROWS):
            far = np.sqrt(np.maximum(2 - 2 * (unit(v[at:at + ROWS]) @ points.T), 0))
            home = far.argmin(axis=1)
            yield at, home, far, far[np.arange(len(far)), home]

    def cells(batch):
        for at, home, far, own in measured(batch):
            yield pa.array(home, pa.int32()), pa.array(own)

    def copies(batch):
        points, most, parts = spots.value
        for at, home, far, own in measured(batch):
            ids = longs(batch.column(0))[at:at + ROWS]
            mine = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[home]
            bound = np.minimum(most + reach, own[:, None] + 2 * reach) + SLACK
            who, cell = np.nonzero((far <= bound) & (np.arange(len(points)) <= home[:, None]))
            times = np.where(cell == home[who], mine[who] + 1, parts[cell])
            who, cell = np.repeat(who, times), np.repeat(cell, times)
            block = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
            kind = np.where((cell == home[who]) & (block == mine[who]), 0, 1)
            for part in range(0, len(who), ROWS):
                some = slice(part, part + ROWS)
                took = pa.array(at + who[some])
                yield (pa.array(cell[some], pa.int32()), pa.array(block[some], pa.int32()), pa.array(kind[some], pa.int32()),
                       batch.column(0).take(took), batch.column(1).take(took), batch.column(2).take(took))

    if radius is None:
        return by_batches(nodes, cells, "cell int, far double")
    kind_of_v = nodes.schema["v"].dataType.elementType.simpleString()
    return by_batches(nodes, copies, f"cell int, block int, kind int, node long, w long, v array<{kind_of_v}>")


class _Block:
    """Vectors of one block with the links found so far."""

    def __init__(self):
        self.ids, self.weights, self.vectors = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def add(self, ids, weights, v):
        self.ids, self.weights = np.r_[self.ids, ids], np.r_[self.weights, weights]
        self.vectors = v if self.vectors is None else np.r_[self.vectors, v]

    def start(self, cosine):
        n = len(self.ids)
        self.root, self.cosine = np.arange(n), cosine
        self.counts = np.zeros(n, np.int64)
        self.meet(self.ids, self.weights, self.vectors, inside=True)

    def meet(self, ids, weights, v, inside=False):
        """Compare rows with the block: their own counts; the block's counts and roots are brought up to date."""
        if not len(self.ids) or not len(ids):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        close = v @ self.vectors.T >= self.cosine
        if inside:
            np.fill_diagonal(close, True)
            self.counts += close @ self.weights - self.weights
        else:
            self.counts += weights @ close
        own = close @ self.weights
        low = np.where(close, self.root, len(self.root)).min(axis=1)
        high = np.where(close, self.root, -1).max(axis=1)
        for i in np.flatnonzero((high >= 0) & (low != high)):
            roots = np.unique(self.root[close[i]])
            self.root[np.isin(self.root, roots)] = roots[0]
        return own, np.where(high >= 0, self.ids[np.minimum(close.argmax(axis=1), len(self.ids) - 1)], 0)


def _counted(batches, cosine: float):
    """(a, b, n): for rows of a block and of its visitors a count of linked vectors, and one link each to the block."""
    def out(a, b, n):
        keep = n > 0
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, n)], ["a", "b", "n"])

    key, block, begun = None, _Block(), False

    def finish():
        if not begun and len(block.ids):
            block.start(cosine)
        if len(block.ids):
            yield out(block.ids, block.ids[block.root], block.counts)

    for batch in batches:
        if not batch.num_rows:
            continue
        where = np.stack([c.to_numpy() for c in batch.columns[:2]], axis=1)
        kind = batch.column(2).to_numpy()
        ids, weights, v = longs(batch.column(3)), longs(batch.column(4)), unit(_matrix(batch.column(5)))
        change = np.r_[True, (where[1:] != where[:-1]).any(axis=1) | (kind[1:] != kind[:-1])]
        starts = np.flatnonzero(change)
        for at, to in zip(starts, np.r_[starts[1:], len(ids)]):
            if key != tuple(where[at]):
                yield from finish()
                key, block, begun = tuple(where[at]), _Block(), False
            if kind[at] == 0:
                block.add(ids[at:to], weights[at:to], v[at:to])
                continue
            if not begun:
                if len(block.ids):
                    block.start(cosine)
                begun = True
            for part in range(at, to, ROWS):
                some = slice(part, min(part + ROWS, to))
                if len(block.ids):
                    own, link = block.meet(ids[some], weights[some], v[some])
                    yield out(ids[some], link, own)
    yield from finish()


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id: str = "vec_id", vector: str = "embedding",
                 cell: int = CELL, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors link when their cosine, in double precision, is at least ``cosine``. Equal vectors are compared once, under a
    number of their own, and count as often as they occur. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing. Vectors of different lengths raise ``ValueError``. Repeated ids are separate vectors
    with one id, each with its row. Rows without an id link like all others and are never kept; ``component_id`` is the
    least id in the component, null when it has none. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    good = rows.filter(usable("v"))
    merged = good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("w"))
    nodes = written(merged.withColumn("node", F.monotonically_increasing_id()), "vectors")
    told = nodes.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("short"), F.max(F.size("v")).alias("long")).first()
    if told["short"] != told["long"]:
        raise ValueError(f"vectors of {told['short']} to {told['long']} components in one table")
    n = told["n"]
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    count = min(pivots, max(1, math.ceil(n / cell)))
    chosen = nodes.orderBy(F.xxhash64("v"), "v").limit(count).select("v").collect()
    points = unit(np.array([list(r["v"]) for r in chosen], float))
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    spots = nodes.select("node", "w", "v")
    sizes = _placed(spots, points, None, reach, None).groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()
    radius, parts = np.zeros(count), np.ones(count, np.int64)
    for r in sizes:
        radius[r["cell"]], parts[r["cell"]] = r["far"], math.ceil(r["n"] / block)
    cells = _placed(spots, points, radius, reach, parts)
    found = written(cells.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
                    .mapInArrow(frugal(lambda batches: _counted(batches, cosine)), "a long, b long, n long"), "links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    rooted = written(nodes.select("node", "least", "w").join(counts, "node", "left").join(components(found, "a", "b"), "node", "left")
                     .select("node", "least", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links"),
                             F.coalesce("component", "node").alias("root")), "rooted")
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(heads, "root").select("node", "n_links", "component_id"), "named")
    keyed = rows.withColumn("ok", F.coalesce(usable("v"), F.lit(False)))
    alone = keyed.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    members = keyed.filter("ok").join(nodes.select("v", "node"), "v").join(named, "node").select("vec_id", "n_links", "component_id")
    return members.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
