"""Rankings built from rankings: weighted fusion and cascades."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigo.functions.vectors import distance, similarity
from vestigo.operators import blocks
from vestigo.operators.distances import distance_scores, feature_distance, matrix, nearest
from vestigo.operators.metric import nearest_pruned, usable
from vestigo.operators.ranking import scored, top_k, union_all
from vestigo.schemas import require
from vestigo.sources.tables import written

# Pairs scored in blocks for the price of one row of a ranking, about: a ranking is shuffled, sorted and joined, a pair is not.
RANKED = 64


def pair_weights(ratio: float) -> list[float]:
    """Weights of two rankings from one ratio."""
    return [ratio, 1 - ratio]


def fuse(lists: Sequence[DataFrame], weights: Sequence[float], id: str = "id",
         combine: Callable[[Column], Column] = F.sum) -> DataFrame:
    """One ranking (query_id, id, score) from several: by default the sum of weighted scores, an absent item counting 0.

    ``combine`` is any aggregate of the weighted scores an item has, such as ``F.max``.
    """
    if len(lists) != len(weights):
        raise ValueError(f"{len(lists)} rankings need as many weights, not {len(weights)}")
    weighted = [scored(df).select("query_id", id, (F.lit(float(w)) * F.col("score")).alias("score"))
                for df, w in zip(lists, weights)]
    return union_all(weighted).groupBy("query_id", id).agg(combine(F.col("score")).alias("score"))


def fused_query(features: DataFrame, query: DataFrame, kinds: Sequence[str], weights: Sequence[float], k: int = 10,
                metric: str = "l2", top_n: int | None = None, id: str = "id", digits: int | None = None) -> DataFrame:
    """Best k items for one query item by weighted similarity over several kinds: (query_id, id, score, rank).

    ``features`` is (id, kind, vector), ``query`` is (query_id, kind, vector) of one item. Each kind is ranked on
    its own part of the table, to the best ``top_n`` when given, with similarity 1 / (1 + distance).
    """
    require(features, id, "kind", vectors=("vector",))
    require(query, "query_id", "kind", vectors=("vector",))
    if len(kinds) != len(weights):
        raise ValueError(f"{len(kinds)} kinds need as many weights, not {len(weights)}")
    name = query.agg(F.first("query_id").alias("query_id")).scalar()
    lists = []
    for kind in kinds:
        one = feature_distance(features.filter(F.col("kind") == kind), query.filter(F.col("kind") == kind), metric, id,
                               digits=digits)
        one = one.filter(F.col("distance").isNotNull() & ~F.isnan("distance"))
        if top_n is not None:
            one = top_k(one, top_n, [("distance", "ascending"), (id, "ascending")], rank=None)
        lists.append(one.select(name.alias("query_id"), id, similarity("distance").alias("score")))
    return _best(fuse(lists, weights, id), k, id, digits, per=())


def fused_batch(features: DataFrame, queries: DataFrame, kinds: Sequence[str], weights: Sequence[float],
                top_n: int | None = None, k: int = 10, metric: str = "l2", id: str = "id", digits: int | None = None) -> DataFrame:
    """``fused_query`` for any number of query items.

    Exact by default: tasks score items on all kinds at once and hand on the best k per query. With ``top_n`` each
    kind contributes its best ``top_n`` per query only, which is cheaper and can change scores and order.
    """
    require(queries, "query_id", "kind", vectors=("vector",))
    if len(kinds) != len(weights):
        raise ValueError(f"{len(kinds)} kinds need as many weights, not {len(weights)}")
    if top_n is None:
        names = list(dict.fromkeys(kinds))
        return _fused_exactly(_wide(features, id, names), _wide(queries, "query_id", names), kinds, weights, k, metric, id, digits)
    lists = []
    for kind in kinds:
        one = nearest(features.filter(F.col("kind") == kind), queries.filter(F.col("kind") == kind), top_n, metric, id,
                      digits=digits)
        lists.append(one.select("query_id", id, similarity("distance").alias("score")))
    return _best(fuse(lists, weights, id), k, id, digits)


def _wide(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(key, v0, v1, ...): the vectors of an item's kinds side by side."""
    return df.filter(F.col("kind").isin(list(names))).groupBy(key).agg(
        *[F.first(F.when(F.col("kind") == n, F.col("vector").cast("array<double>")), ignorenulls=True).alias(f"v{i}")
          for i, n in enumerate(names)])


def _fused_exactly(items: DataFrame, asked: DataFrame, kinds, weights, k, metric, id, digits) -> DataFrame:
    """Best k items per query from the scores of all pairs; both sides as ``_wide`` makes them."""
    names = list(dict.fromkeys(kinds))

    def whole(q: pa.Table, c: pa.Table):
        step = max(1, blocks.CELLS // max(1, len(q)))
        for first in range(0, len(c), step):
            part = c.slice(first, step)
            total = np.full((len(q), len(part)), np.nan)
            for kind, weight in zip(kinds, weights):
                a, b = (t.column(f"v{names.index(kind)}") for t in (q, part))
                rows, columns = (np.flatnonzero(x.is_valid().to_numpy()) for x in (a, b))
                if not len(rows) or not len(columns):
                    continue
                _, scores = next(distance_scores(a.drop_null(), b.drop_null(), metric, 1 << 62, digits, cells=1 << 62))
                near = weight / (1 - scores)
                at = np.ix_(rows, columns)
                total[at] = np.where(np.isnan(near), total[at], np.nan_to_num(total[at]) + near)
            yield first, total if digits is None else np.round(total, digits)

    def scorer(q: pa.Table, c: pa.Table, best: blocks.BestK):
        views = [(_filled(q.column(f"v{i}")), _filled(c.column(f"v{i}"))) for i in range(len(names))]
        if metric != "l2" or min(weights) < 0 or any(a is None or b is None for a, b in views):
            yield from blocks.dense(whole)(q, c, best)
            return
        yield from _fused_pairs(views, [(names.index(kind), weight) for kind, weight in zip(kinds, weights)], digits, best)

    size = sum((F.coalesce(F.size(F.col(f"v{i}")), F.lit(0)) * 8 for i in range(len(names))), F.lit(0))
    found = blocks.best_k(asked, items, k, scorer, query_id="query_id", id=id,
                          query_size=size, corpus_size=size)
    return _best(found.select("query_id", id, "score"), k, id, digits)


def _filled(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray] | None:
    """A column's vectors with zeros for those that are null or not finite, and where they are usable; None if squares overflow."""
    there = column.is_valid().to_numpy()
    vectors = matrix(column.drop_null())
    out = np.zeros((len(there), vectors.shape[1]))
    out[there] = vectors
    good = there & np.isfinite(out).all(1)
    out[~good] = 0
    with np.errstate(over="ignore"):
        return (out, good) if np.isfinite((out * out).sum(1)).all() else None


def _fused_pairs(views, terms: Sequence[tuple[int, float]], digits: int | None, best: blocks.BestK):
    """Pairs that can be among the best by l2: similarities at least as large as the true ones come from one matrix product per
    kind; only pairs that these leave in question are computed exactly."""
    unit, gap, sides = 0.0 if digits is None else 10.0 ** -digits, 0.0, []
    total_weight = {i: sum(w for j, w in terms if j == i) for i, _ in terms}
    for i, weight in total_weight.items():
        (a, use_a), (b, use_b) = views[i]
        if not a.shape[1] or not b.shape[1]:  # no vector of this kind on one side
            continue
        if a.shape[1] != b.shape[1]:
            raise ValueError(f"vectors of unequal length: {a.shape[1]} and {b.shape[1]}")
        a2, b2 = (a * a).sum(1)[:, None], (b * b).sum(1)[:, None]
        slack = 1e-13 * (a.shape[1] + 8) * (a2.max(initial=0) + b2.max(initial=0))
        gap += weight * (np.sqrt(2 * slack) + unit)
        sides.append((weight, np.hstack([-2 * a, a2, np.ones_like(a2)]), np.hstack([b, np.ones_like(b2), b2]), slack,
                      None if use_a.all() and use_b.all() else (use_a, use_b)))
    gap += unit + 1e-12
    n_q, n_c = len(views[0][0][0]), len(views[0][1][0])
    who, step = np.arange(n_q), max(1, 4 * blocks.CELLS // max(n_q, 1))
    for first in range(0, n_c if sides else 0, step):
        total = 0.0
        for weight, left, right, slack, used in sides:
            near = left @ right[first:first + step].T
            near -= slack
            np.maximum(near, 0, out=near)
            np.sqrt(near, out=near)
            near += 1
            np.divide(weight, near, out=near)
            if used is not None:
                near *= used[0][:, None] & used[1][None, first:first + step]
            total = near + total
        q, d = best.sifted(total, lambda floor: floor - gap, lambda rough: rough - gap, who)
        for at in range(0, len(q), 1 << 16):
            x, y = q[at:at + (1 << 16)], first + d[at:at + (1 << 16)]
            scores, known = np.zeros(len(x)), np.zeros(len(x), bool)
            for i, weight in terms:
                (a, use_a), (b, use_b) = views[i]
                if not a.shape[1] or not b.shape[1]:
                    continue
                apart = np.sqrt(((a[x] - b[y]) ** 2).sum(1))
                there = use_a[x] & use_b[y]
                scores += np.where(there, weight / (1 + (apart if digits is None else np.round(apart, digits))), 0.0)
                known |= there
            scores = scores if digits is None else np.round(scores, digits)
            good = known & (scores >= best.floor[x])
            yield x[good], y[good], scores[good]


class Fused(NamedTuple):
    """Ranking (query_id, id, score, rank); pairs of a query and an item scored in any kind, with the rounds they took."""

    found: DataFrame
    scored: int
    rounds: int


def fused_threshold(features: DataFrame, queries: DataFrame, kinds: Sequence[str], weights: Sequence[float], k: int = 10,
                    metric: str = "l2", id: str = "id", digits: int | None = None, depth: int | None = None,
                    growth: int = 4, **cells) -> Fused:
    """``fused_batch`` by the threshold algorithm (Fagin, Lotem and Naor, 2001): exact, without scoring every item.

    Each kind is ranked to a depth, by ``metric.nearest_pruned`` with the settings ``cells``; items that any ranking shows are
    scored on all kinds. No other item can beat the weighted sum of the similarities at that depth, so a query whose k-th
    score lies above it is done. Queries that are not go on with ``growth`` times the depth, as long as that costs less than scoring
    every pair in blocks, which the queries still open then get. A deeper ranking scores at least the pairs that the last one
    scored for a query, and each of its rows costs ``RANKED`` pairs, so no ranking grows with the collection. Weights must not be negative. Items and queries without a vector of a kind count 0 there.
    """
    require(features, id, "kind", vectors=("vector",))
    require(queries, "query_id", "kind", vectors=("vector",))
    if len(kinds) != len(weights) or any(w < 0 for w in weights):
        raise ValueError(f"{len(kinds)} kinds need as many weights, none of them negative")
    names = list(dict.fromkeys(kinds))

    items, todo = written(_wide(features, id, names), "wide"), written(_wide(queries, "query_id", names), "wide")
    other = items.select(F.col(id), *[F.col(f"v{i}").alias(f"w{i}") for i in range(len(names))])
    n, depth, unit = items.count(), depth or max(4 * k, 64), 0.0 if digits is None else 10.0 ** -digits
    done, pairs, rounds = [], 0, 0
    while True:
        lists, rounds, asked, before = [], rounds + 1, todo.count(), pairs
        for i in range(len(names)):
            one = nearest_pruned(items.select(id, F.col(f"v{i}").alias("vector")), todo.select("query_id", F.col(f"v{i}").alias("vector")),
                                 depth, metric, id, digits=digits, **cells)
            lists.append(written(one.found, "ranking"))
            pairs += one.scored.first()[0]
        each = (pairs - before) / max(asked, 1)
        seen = written(union_all([one.select("query_id", id) for one in lists]).distinct(), "seen")
        pairs += seen.count()
        rows = seen.join(todo, "query_id").join(other, id)
        total, any_kind = F.lit(0.0), F.lit(False)
        for kind, weight in zip(kinds, weights):
            apart = distance(f"v{names.index(kind)}", f"w{names.index(kind)}", metric)
            apart = apart if digits is None else F.round(apart, digits)
            near = F.when(apart.isNotNull() & ~F.isnan(apart), F.lit(float(weight)) / (1 + apart))
            total, any_kind = total + F.coalesce(near, F.lit(0.0)), any_kind | near.isNotNull()
        scores = written(_best(rows.filter(any_kind).select("query_id", id, total.alias("score")), k, id, digits), "scores")
        if depth >= n:
            done.append(scores)
            break
        beyond = [one.filter(F.col("rank") == depth).select("query_id", (F.lit(float(sum(w for x, w in zip(kinds, weights) if x == name)))
                  * similarity("distance")).alias("share")) for name, one in zip(names, lists)]
        least = union_all(beyond).groupBy("query_id").agg(F.sum("share").alias("least"))
        floor = scores.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        settled = todo.select("query_id").join(floor, "query_id", "left").join(least, "query_id", "left").filter(
            F.col("least").isNull() | (F.col("floor") > F.col("least") + unit)).select("query_id")
        settled = written(settled, "settled")
        done.append(scores.join(settled, "query_id", "left_semi"))
        todo = written(todo.join(settled, "query_id", "left_anti"), "todo")
        if todo.isEmpty():
            break
        depth *= growth
        if depth * RANKED + each >= n:
            pairs, rounds = pairs + n * todo.count(), rounds + 1
            done.append(_fused_exactly(_rankable(items, id, names, metric), _rankable(todo, "query_id", names, metric),
                                       kinds, weights, k, metric, id, digits))
            break
    return Fused(union_all(done), pairs, rounds)


def _rankable(wide: DataFrame, key: str, names: Sequence[str], metric: str) -> DataFrame:
    """Null in place of the vectors that ``nearest_pruned`` leaves out of its rankings."""
    return wide.select(key, *[F.when(usable(f"v{i}", metric), F.col(f"v{i}")).alias(f"v{i}") for i in range(len(names))])


def _best(fused: DataFrame, k: int, id: str, digits: int | None, per: Sequence[str] = ("query_id",)) -> DataFrame:
    if digits is not None:
        fused = fused.withColumn("score", F.round("score", digits))
    return top_k(fused, k, [("score", "descending"), (id, "ascending")], per=per)


class Stage(NamedTuple):
    """One cascade step: rank by this vector column with this metric and keep that many."""

    vector: str
    metric: str
    keep: int


def cascade(items: DataFrame, query: DataFrame, stages: Sequence[Stage], id: str = "id",
            digits: int | None = None) -> DataFrame:
    """Items surviving all stages with the last distance and rank: (id, distance, rank).

    Each stage ranks only the survivors of the stage before. Survivors carry the vectors the later stages need, so
    the collection is read once.
    """
    rows = items
    for n, stage in enumerate(stages):
        later = tuple(dict.fromkeys(s.vector for s in stages[n + 1:]))
        rows = feature_distance(rows, query, stage.metric, id, stage.vector, digits, keep=later)
        rows = top_k(rows, stage.keep, [("distance", "ascending"), (id, "ascending")],
                     rank="rank" if n == len(stages) - 1 else None)
    return rows


def projected_kinds(items: DataFrame, steps: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The feature table of a frame by one projection per kind; apply the same steps to collection and query items."""
    return union_all([items.transform(step).withColumn("kind", F.lit(kind)) for kind, step in steps.items()])
