"""Distance ranking of feature vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigo.functions.vectors import METRICS, distance
from vestigo.operators import blocks
from vestigo.operators.ranking import top_k
from vestigo.schemas import require

#: Squared lengths below it lose digits.
TINY = 1e-280
#: Knots between which l1 distances are taken by products, rows that place them, and sums of ranges that floats can hold.
SEGMENTS, KNOT_ROWS, PLAIN = 3, 1024, (1e-25, 1e25)
#: Widest vectors whose space boxes divide well, items of a box, boxes of a large box, large boxes and boxes tried first, queries or boxes
#: looked at together.
NARROW, BOX, FAN, HOMES, AHEAD, LOOK = 8, 64, 64, 2, 8, 1024


def feature_distance(corpus: DataFrame, query: DataFrame, metric: str = "l2", id: str = "id", vector: str = "vector",
                     digits: int | None = None, missing: str = "null", keep: tuple[str, ...] = ()) -> DataFrame:
    """Distance of every item to one query vector: (id, distance).

    ``query`` has one row and enters the plan as a scalar subquery. An item without a usable vector gets a null
    distance, or -1 with ``missing="sentinel"``.
    """
    require(corpus, id, *keep, vectors=(vector,))
    require(query, vectors=(vector,))
    if missing not in ("null", "sentinel"):
        raise ValueError("missing must be 'null' or 'sentinel'")
    one = query.select(vector).scalar()
    rows = corpus.select(id, *keep, F.col(vector).alias("_v"), one.alias("_q"))
    value = distance("_v", "_q", metric)
    if digits is not None:
        value = F.round(value, digits)
    if missing == "sentinel":
        value = F.coalesce(value, F.lit(-1.0))
    return rows.select(id, *keep, value.alias("distance"))


def nearest(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id: str = "id",
            vector: str = "vector", digits: int | None = None, ship_bytes: int = blocks.SHIP_BYTES,
            block_bytes: int = blocks.BLOCK_BYTES, hold_rows: int = blocks.HOLD_ROWS) -> DataFrame:
    """The k items nearest to each query vector: (query_id, id, distance, rank), ties by ascending id.

    Works for any number of queries (query_id, vector). Items whose distance is null or NaN do not take part.
    """
    require(corpus, id, vectors=(vector,))
    require(queries, "query_id", vectors=(vector,))
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    left = queries.select("query_id", vector).filter(F.col(vector).isNotNull())
    right = corpus.select(id, vector).filter(F.col(vector).isNotNull())
    size = F.size(vector) * 8

    def scorer(q: pa.Table, c: pa.Table, best: blocks.BestK):
        return near_pairs(q.column(vector), c.column(vector), metric, digits, best)

    def whole(c: pa.Table):
        return boxed_cosine(c.column(vector), vector, digits)

    narrow = metric == "cosine" and not right.filter(F.size(vector) <= NARROW).isEmpty()
    found = blocks.best_k(left, right, k, scorer, query_id="query_id", id=id, query_size=size, corpus_size=size,
                          ship_bytes=ship_bytes, block_bytes=block_bytes, hold_rows=hold_rows, whole=whole if narrow else None)
    ranked = found.select("query_id", id, (F.lit(0.0) - F.col("score")).alias("distance"))
    return top_k(ranked, k, [("distance", "ascending"), (id, "ascending")], per=["query_id"])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a float64 matrix; lists of different length raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // n if n else 0
    if n and pc.any(pc.not_equal(pc.list_value_length(column), width)).as_py():
        raise ValueError("vectors of unequal length in one column")
    return flat.reshape(n, width)


def near_pairs(queries: pa.ChunkedArray, items: pa.ChunkedArray, metric: str, digits: int | None, best: blocks.BestK):
    """(query numbers, item numbers, negated distances) of all pairs that can be among the best.

    For l2, cosine and l1 one matrix product gives rough values; only pairs that these leave in question are computed exactly.
    """
    a, b = matrix(queries), matrix(items)
    if len(a) and len(b) and a.shape[1] != b.shape[1]:
        raise ValueError(f"vectors of unequal length: {a.shape[1]} and {b.shape[1]}")
    with np.errstate(over="ignore", invalid="ignore"):
        a2, b2 = (a * a).sum(1), (b * b).sum(1)
    use_a, use_b = np.isfinite(a).all(1), np.isfinite(b).all(1)
    if metric == "l1" and use_a.any() and use_b.any() and not (np.isinf(a).any() or np.isinf(b).any()):
        who, which = np.flatnonzero(use_a), np.flatnonzero(use_b)
        found = _near_l1(a[who], b[which], digits, best, who)
        if found is not None:
            for q, d, scores in found:
                yield who[q], which[d], scores
            return
    if metric == "cosine":
        use_a, use_b = use_a & (a != 0).any(1), use_b & (b != 0).any(1)
    plain = all(np.isfinite(x).all() and (metric == "l2" or not (x < TINY).any()) for x in (a2[use_a], b2[use_b]))
    if metric not in ("l2", "cosine") or not plain or not a.shape[1] or not len(a) or not len(b):
        yield from blocks.dense(lambda q, c: distance_scores(q, c, metric, best.k, digits))(queries, items, best)
        return
    who, which = np.flatnonzero(use_a), np.flatnonzero(use_b)
    a, b, a2, b2 = a[who], b[which], a2[who], b2[which]
    unit = 0.0 if digits is None else 10.0 ** -digits
    if metric == "cosine":
        left, right = a / np.sqrt(a2)[:, None], b / np.sqrt(b2)[:, None]
        margin = unit + 1e-9

        def reach(floor):
            return 1 + floor - margin

        def least(rough):
            return rough - 1 - margin
    else:
        # half of |a|^2 less the square of the distance
        left, right = np.hstack([a, np.ones((len(a), 1))]), np.hstack([b, -b2[:, None] / 2])
        slack = 1e-13 * (a.shape[1] + 8) * (a2 + b2.max(initial=0))

        def reach(floor):
            return (a2 - (unit - floor) ** 2 - slack) / 2

        def least(rough):
            return -np.sqrt(np.maximum(a2 - 2 * rough + slack, 0)) - unit

    step = max(1, 16 * blocks.CELLS // max(len(a), 1))
    for first in range(0, len(b), step):
        q, d = best.sifted(left @ right[first:first + step].T, reach, least, who)
        for at in range(0, len(q), 1 << 16):
            i, j = q[at:at + (1 << 16)], first + d[at:at + (1 << 16)]
            if metric == "cosine":
                value = 1 - (a[i] * b[j]).sum(1) / (np.sqrt(a2[i]) * np.sqrt(b2[j]))
            else:
                value = np.sqrt(((a[i] - b[j]) ** 2).sum(1))
            scores = (-value if digits is None else np.round(-value, digits)) + 0.0
            good = scores >= best.floor[who[i]]
            yield who[i[good]], which[j[good]], scores[good]


def _near_l1(a: np.ndarray, b: np.ndarray, digits: int | None, best: blocks.BestK, who: np.ndarray):
    """(row of a, row of b, negated l1 distance) of pairs that can be among the best; None where floats cannot hold the values.

    Knots cut each dimension's range into segments. The line from knot to knot of |x - y|, as a function of y, is a product of
    what x and what y tell, and is exact unless both lie in one segment. There, at parts u and v of a segment of length g, it is
    too large by 2 g min(u, v) (1 - max(u, v)), which is at most 2 g sqrt(u (1 - u) v (1 - v)), a product again. Their difference
    is never above the distance; only pairs for which it does not exceed the k-th distance are computed exactly.
    """
    low, high = np.minimum(a.min(0), b.min(0)), np.maximum(a.max(0), b.max(0))
    reach = float((high - low).sum()) if a.shape[1] else 0.0
    if best.k == 0 or not PLAIN[0] < reach < PLAIN[1]:
        return None
    inner = np.quantile(b[::max(1, len(b) // KNOT_ROWS)], [(i + 1) / SEGMENTS for i in range(SEGMENTS - 1)], axis=0)
    knots = np.vstack([low, np.clip(inner, low, high), high])
    unit = (0.0 if digits is None else 10.0 ** -digits) + 1e-12 * reach
    margin = unit + 4 * (2 * SEGMENTS * a.shape[1] + 8) * float(np.finfo(np.float32).eps) * reach

    def bumps(v):
        at = (v[:, None, :] >= knots[1:-1]).sum(1)
        start = np.take_along_axis(knots, at, 0)
        gap = np.take_along_axis(knots, at + 1, 0) - start
        part = np.clip((v - start) / np.where(gap > 0, gap, 1), 0, 1)
        return at, part, np.sqrt(part * (1 - part) * gap)

    def told_by_a():
        at, _, bump = bumps(a)
        ends = np.abs(a[:, None, :] - knots)
        lines = ends[:, 1:] - ends[:, :1]
        own = np.zeros((len(a), SEGMENTS, a.shape[1]))
        np.put_along_axis(own, at[:, None, :], -2 * bump[:, None, :], 1)
        return -np.concatenate([lines, own], axis=1, dtype=np.float32).reshape(len(a), -1), -ends[:, 0].sum(1)

    def told_by_b(rows):
        at, part, bump = bumps(rows)
        lines, own = np.zeros((2, len(rows), SEGMENTS + 1, a.shape[1]), np.float32)
        np.put_along_axis(lines, at[:, None, :], 1 - part[:, None, :], 1)
        np.put_along_axis(lines, at[:, None, :] + 1, part[:, None, :], 1)
        np.put_along_axis(own, at[:, None, :], bump[:, None, :], 1)
        return np.concatenate([lines[:, 1:], own[:, :-1]], axis=1).reshape(len(rows), -1)

    by_entry, items = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    short_a, short_b = (a - low).astype(np.float32), (b - low).astype(np.float32)

    def exact(q, d):
        # entry after entry, as the sums over all pairs
        value = np.concatenate([np.abs(by_entry[:, q[at:at + (1 << 13)]] - items[:, d[at:at + (1 << 13)]]).sum(0)
                                for at in range(0, len(q), 1 << 13)] or [np.zeros(0)])
        return (-value if digits is None else np.round(-value, digits)) + 0.0

    def pairs():
        left, least = told_by_a()
        step = max(1, 8 * blocks.CELLS // len(a))
        for first in range(0, len(b), step):
            rough = left @ told_by_b(b[first:first + step]).T
            hit = rough >= (best.floor[who] - least - margin).astype(np.float32)[:, None]
            if rough.shape[1] > best.k and np.count_nonzero(hit) > 2 * best.k * len(a):
                # k items of this block, scored, are a floor
                some = first + np.argpartition(rough, -best.k, axis=1)[:, -best.k:]
                scores = exact(np.repeat(np.arange(len(a)), best.k), some.ravel()).reshape(some.shape)
                best.floor[who] = np.maximum(best.floor[who], scores.min(1))
                hit = rough >= (best.floor[who] - least - margin).astype(np.float32)[:, None]
            q, d = blocks.places(hit)
            for at in range(0, len(q), 1 << 14):
                i, j = q[at:at + (1 << 14)], first + d[at:at + (1 << 14)]
                near = np.abs(short_a[i] - short_b[j]).sum(1) <= (margin - best.floor[who[i]]).astype(np.float32)
                i, j = i[near], j[near]
                scores = exact(i, j)
                good = scores >= best.floor[who[i]]
                yield i[good], j[good], scores[good]

    return pairs()


def _boxes(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The points' order by halves: every part is cut at the middle of its longest side until parts have ``most`` points at most;
    and where the parts begin."""
    order, edges = np.arange(len(points)), np.array([0, len(points)])
    while np.diff(edges).max() > most:
        held, sizes = points[order], np.diff(edges)
        side = (np.maximum.reduceat(held, edges[:-1]) - np.minimum.reduceat(held, edges[:-1])).argmax(1)
        part = np.repeat(np.arange(len(sizes)), sizes)
        order = order[np.lexsort((held[np.arange(len(held)), side[part]], part))]
        edges = np.sort(np.concatenate([edges, edges[:-1] + sizes // 2]))
    return order, edges


def _likeness(directions: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Most that each direction's product with a point of its box can be; all have a direction's entries last."""
    total = 0.0
    for j in range(directions.shape[-1]):
        x = directions[..., j]
        apart = np.maximum(np.maximum(low[..., j] - x, x - high[..., j]), 0)
        total = total + apart * apart
    return 1 - total / 2


def boxed_cosine(items: pa.ChunkedArray, vector: str, digits: int | None):
    """The nearest by cosine among all items of a part, for short vectors: a finder of the best (``blocks.Whole``).

    Directions are put into boxes, and boxes into larger ones. A query scores the nearest boxes of its nearest large ones; the k-th
    distance found there bounds the large boxes, then their boxes, that it has to look at. Scores are those of ``near_pairs``,
    which gets what cannot be handled so.
    """
    b = matrix(items)
    with np.errstate(over="ignore", invalid="ignore"):
        b2 = (b * b).sum(1)
    which = np.flatnonzero(np.isfinite(b).all(1) & (b != 0).any(1))
    sound = bool(len(which)) and 0 < b.shape[1] <= NARROW and np.isfinite(b2[which]).all() and not (b2[which] < TINY).any()
    if sound:
        order, edges = _boxes(b[which] / np.sqrt(b2[which])[:, None], BOX)
        which = which[order]
        b, b2 = b[which], b2[which]
        right = b / np.sqrt(b2)[:, None]
        low, high = np.minimum.reduceat(right, edges[:-1]), np.maximum.reduceat(right, edges[:-1])
        fan = min(FAN, len(low))  # both are powers of two
        large_low, large_high = low.reshape(-1, fan, b.shape[1]).min(1), high.reshape(-1, fan, b.shape[1]).max(1)
        place = edges[:-1, None] + np.arange(np.diff(edges).max())
        there = place < edges[1:, None]
        place = np.where(there, place, 0)
    margin = (0.0 if digits is None else 10.0 ** -digits) + 1e-9

    def reach(floor):
        return 1 + floor - margin

    def search(queries: pa.Table, best: blocks.BestK):
        a = matrix(queries.column(vector))
        with np.errstate(over="ignore", invalid="ignore"):
            a2 = (a * a).sum(1)
        usable = np.flatnonzero(np.isfinite(a).all(1) & (a != 0).any(1))
        if not sound or not len(usable) or a.shape[1] != b.shape[1] or not np.isfinite(a2[usable]).all() or (a2[usable] < TINY).any():
            for first in range(0, len(items), blocks.BATCH_ROWS):
                for q, d, scores in near_pairs(queries.column(vector), items.slice(first, blocks.BATCH_ROWS), "cosine", digits, best):
                    yield q, first + d, scores
            return
        for at in range(0, len(usable) if best.k else 0, LOOK):
            who = usable[at:at + LOOK]
            for q, d in looked_up(a[who] / np.sqrt(a2[who])[:, None], who, best):
                i = who[q]
                value = 1 - (a[i] * b[d]).sum(1) / (np.sqrt(a2[i]) * np.sqrt(b2[d]))
                scores = (-value if digits is None else np.round(-value, digits)) + 0.0
                good = scores >= best.floor[i]
                yield i[good], which[d[good]], scores[good]

    def looked_up(left: np.ndarray, who: np.ndarray, best: blocks.BestK):
        """(query, item) numbers of all pairs that can be among the best, a bounded number at a time."""
        one = np.arange(len(left))
        large = _likeness(left[:, None, :], large_low, large_high)
        nearest_large = np.argpartition(-large, min(HOMES, large.shape[1]) - 1, axis=1)[:, :HOMES]
        home = (nearest_large[:, :, None] * fan + np.arange(fan)).reshape(len(left), -1)
        some = min(home.shape[1], max(AHEAD, -(-4 * best.k // BOX)))
        near = np.take_along_axis(home, np.argpartition(-_likeness(left[:, None, :], low[home], high[home]), some - 1, axis=1)[:, :some], 1)
        for first in range(0, len(left), max(1, LOOK // some)):
            part = slice(first, first + max(1, LOOK // some))
            at = place[near[part]].reshape(len(one[part]), -1)
            rough = np.where(there[near[part]].reshape(at.shape), np.einsum("qd,qpd->qp", left[part], right[at]), -np.inf)
            if rough.shape[1] > best.k:  # k items reach the cut
                cut = np.partition(rough, -best.k, axis=1)[:, -best.k] - 1 - margin
                best.floor[who[part]] = np.maximum(best.floor[who[part]], cut)
        q, box = blocks.places(large >= reach(best.floor[who])[:, None] - 1e-9)
        for first in range(0, len(q), LOOK):
            asked = np.repeat(q[first:first + LOOK], fan)
            boxes = (box[first:first + LOOK, None] * fan + np.arange(fan)).ravel()
            wanted = _likeness(left[asked], low[boxes], high[boxes]) >= reach(best.floor[who[asked]]) - 1e-9
            asked, boxes = asked[wanted], boxes[wanted]
            for at in range(0, len(asked), LOOK):
                x, y = asked[at:at + LOOK], place[boxes[at:at + LOOK]]
                rough = np.einsum("nd,npd->np", left[x], right[y])
                n, p = blocks.places((rough >= reach(best.floor[who[x]])[:, None]) & there[boxes[at:at + LOOK]])
                yield x[n], y[n, p]

    return search


def distance_scores(queries: pa.ChunkedArray, items: pa.ChunkedArray, metric: str, k: int, digits: int | None,
                    cells: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Matrices of negated distances, block by block of items."""
    a, b = matrix(queries), matrix(items)
    if len(a) and len(b) and a.shape[1] != b.shape[1]:
        raise ValueError(f"vectors of unequal length: {a.shape[1]} and {b.shape[1]}")
    if cells is None:
        # matrix products gain from large blocks, sums over one dimension after the other from small ones
        cells = blocks.CELLS if metric in ("l1", "chi2") else 16 * blocks.CELLS
    step = max(1, cells // max(len(a), 1))
    for first in range(0, len(b), step):
        with np.errstate(invalid="ignore", divide="ignore"):
            scores = -_distances(a, b[first:first + step], metric, k, 0.0 if digits is None else 10.0 ** -digits)
        if digits is not None:
            scores = np.round(scores, digits)
        yield first, scores + 0.0


def _distances(a: np.ndarray, b: np.ndarray, metric: str, k: int, unit: float) -> np.ndarray:
    """Distances [query, item]; for l2, pairs that cannot be among a query's best k may stay NaN.

    ``unit`` is the step distances are rounded to afterwards, within which they may still change places.
    """
    if metric == "l2":
        return _near_l2(a, b, k, unit)
    if metric == "cosine":
        return 1 - (a @ b.T) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :])
    if metric == "tanimoto":
        dot = a @ b.T
        return 1 - dot / ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - dot)
    total = np.zeros((len(a), len(b)))
    apart = np.empty_like(total)
    for j in range(a.shape[1]):
        x, y = a[:, j][:, None], b[:, j][None, :]
        if metric == "l1":
            np.subtract(x, y, out=apart)
            np.abs(apart, out=apart)
            total += apart
        else:
            both = x + y
            total += np.where(both != 0, (x - y) ** 2 / both, 0.0)
    return total


def _near_l2(a: np.ndarray, b: np.ndarray, k: int, unit: float) -> np.ndarray:
    """Squares by one matrix product, then exact differences for every pair the rounding error leaves in question."""
    a2, b2 = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    rough = a2 + b2 - 2 * (a @ b.T)
    rough[np.isnan(rough)] = np.inf
    slack = 1e-13 * (a.shape[1] + 8) * (a2 + b2)
    if k < len(b):
        # any of the true best k lies within the k-th smallest upper bound
        bound = np.partition(rough + slack, k - 1, axis=1)[:, k - 1][:, None] if k else np.full((len(a), 1), -np.inf)
        bound = np.where(bound > 0, (np.sqrt(np.maximum(bound, 0)) + unit) ** 2, bound)
        q, d = np.nonzero((rough - slack <= bound) & np.isfinite(rough))
    else:
        q, d = np.nonzero(np.isfinite(rough))
    out = np.full(rough.shape, np.nan)
    for at in range(0, len(q), 1 << 18):
        i, j = q[at:at + (1 << 18)], d[at:at + (1 << 18)]
        out[i, j] = np.sqrt(((a[i] - b[j]) ** 2).sum(1))
    # squares that overflow: the length of the difference, scaled by its largest entry
    q, d = np.nonzero(~np.isfinite(rough) & np.isfinite(a).all(1)[:, None] & np.isfinite(b).all(1)[None, :])
    for at in range(0, len(q), 1 << 18):
        i, j = q[at:at + (1 << 18)], d[at:at + (1 << 18)]
        apart = a[i] - b[j]
        most = np.maximum(np.abs(apart).max(1, initial=0), np.finfo(float).tiny)
        out[i, j] = most * np.sqrt(((apart / most[:, None]) ** 2).sum(1))
    return out
