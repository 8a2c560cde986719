"""Sums over a whole collection that are too large for rows of a shuffle: one state per task, merged level by level.

A task folds its rows into one state and hands on one row, whatever the vectors' length. States are merged by ever
fewer tasks, a sixteenth at each level, and a merging task holds two of them at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vestigo.operators.distances import matrix

FAN = 16

State = tuple[np.ndarray, ...]


def folded(df: DataFrame, fold: Callable[[State | None, pa.RecordBatch], State | None],
           merge: Callable[[State, State], State], parts: int) -> DataFrame:
    """One row (s0, s1, ... arrays of doubles) with the merged state of all rows; no row when no task has a state.

    ``fold`` adds a batch to a task's state, ``merge`` joins two states; ``parts`` is the number of arrays of a state.
    """
    names = [f"s{i}" for i in range(parts)]
    schema = ", ".join(f"{name} array<double>" for name in names)

    def row(state: State) -> pa.RecordBatch:
        arrays = [pa.ListArray.from_arrays(np.array([0, a.size], np.int32), pa.array(np.ravel(a), pa.float64())) for a in state]
        return pa.RecordBatch.from_arrays(arrays, names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = fold(state, batch)
        if state is not None:
            yield row(state)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for i in range(batch.num_rows):
                more = tuple(c.slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
                state = more if state is None else merge(state, more)
        if state is not None:
            yield row(state)

    states = df.mapInArrow(first, schema)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while tasks > 1:
        tasks = -(-tasks // FAN)
        states = states.repartition(tasks).mapInArrow(joined, schema)
    return states if tasks == 1 else states.repartition(1).mapInArrow(joined, schema)


def state_of(states: DataFrame) -> State | None:
    """The merged state itself, for the driver; None without rows."""
    table = states.toArrow()
    return tuple(c.combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in table.columns) if table.num_rows else None


def product_state(pairs: DataFrame) -> DataFrame:
    """(s0 = [rows, entries of the text view], s1 = means, s2 = centred products, upper triangle) of paired views, in one pass.

    States are merged by their means (Chan, Golub and LeVeque, 1979), so nothing is lost to large means.
    """
    def fold(state, batch):
        left, right = matrix(batch.column(0)), matrix(batch.column(1))
        x = np.hstack([left, right])
        mean = x.mean(axis=0)
        centred = x - mean
        new = np.array([len(x), left.shape[1]], float), mean, (centred.T @ centred)[np.triu_indices(len(mean))]
        return new if state is None else merge_products(state, new)

    return folded(pairs.select("text_vector", "image_vector"), fold, merge_products, 3)


def merge_products(a: State, b: State) -> State:
    if len(a[1]) != len(b[1]) or a[0][1] != b[0][1]:
        raise ValueError("vectors of unequal length in one column")
    n = a[0][0] + b[0][0]
    apart = b[1] - a[1]
    products = a[2] + b[2] + np.outer(apart, apart)[np.triu_indices(len(apart))] * (a[0][0] * b[0][0] / n)
    return np.array([n, a[0][1]]), a[1] + apart * (b[0][0] / n), products


def product_cells(state: DataFrame) -> DataFrame:
    """(i, j, total), i <= j, of a state of ``product_state``."""
    def cells(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                mean, total = (batch.column(c).slice(i, 1).flatten() for c in (1, 2))
                rows, columns = np.triu_indices(len(mean))
                yield from pa.table({"i": pa.array(rows, pa.int32()), "j": pa.array(columns, pa.int32()), "total": total}).to_batches(1 << 16)

    return state.mapInArrow(cells, "i int, j int, total double")


def spread_state(pairs: DataFrame) -> DataFrame:
    """(s0 = [rows, entries of the text view], s1 = means, s2 = centred sums of squares) over both views."""
    def fold(state, batch):
        left, right = matrix(batch.column(0)), matrix(batch.column(1))
        x = np.hstack([left, right])
        mean = x.mean(axis=0)
        new = np.array([len(x), left.shape[1]], float), mean, ((x - mean) ** 2).sum(axis=0)
        return new if state is None else merge(state, new)

    def merge(a, b):
        if len(a[1]) != len(b[1]) or a[0][1] != b[0][1]:
            raise ValueError("vectors of unequal length in one column")
        n, apart = a[0][0] + b[0][0], b[1] - a[1]
        return np.array([n, a[0][1]]), a[1] + apart * (b[0][0] / n), a[2] + b[2] + apart ** 2 * (a[0][0] * b[0][0] / n)

    return folded(pairs.select("text_vector", "image_vector"), fold, merge, 3)


def product_with(pairs: DataFrame, means: np.ndarray, left: np.ndarray, right: np.ndarray) -> State:
    """Centred X'(X left) of the text view and X'(X right) of the image view; no matrix is larger than a factor."""
    shipped = pairs.sparkSession.sparkContext.broadcast((means, left, right))

    def fold(state, batch):
        means, left, right = shipped.value
        x, y = matrix(batch.column(0)) - means[:len(left)], matrix(batch.column(1)) - means[len(left):]
        new = x.T @ (x @ left), y.T @ (y @ right)
        return new if state is None else (state[0] + new[0], state[1] + new[1])

    found = state_of(folded(pairs.select("text_vector", "image_vector"), fold, lambda a, b: (a[0] + b[0], a[1] + b[1]), 2))
    shipped.destroy()
    return found[0].reshape(left.shape), found[1].reshape(right.shape)
