"""Search across two media: pair the views, correlate them, rank one medium for a query from the other."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigo.operators import moments
from vestigo.operators.distances import matrix, nearest
from vestigo.schemas import require
from vestigo.sources.tables import written

DEFAULT_K = 100
#: Entries of both views together that the driver solves as they are; beyond it, directions of each view's basis at first,
#: the share of variance the bases must hold, and passes over the pairs that improve a basis.
MAX_VIEW, RANK, LEAST_SHARE, PASSES = 2048, 64, 0.99, 6
TINY = np.finfo(float).tiny


class Correlation(NamedTuple):
    """Fitted canonical correlation: per view its mean and its projection, and the correlations in falling order."""

    text_mean: np.ndarray
    image_mean: np.ndarray
    text_weights: np.ndarray
    image_weights: np.ndarray
    correlations: np.ndarray


def pair_views(text: DataFrame, image: DataFrame, pairs: DataFrame) -> DataFrame:
    """(text_id, image_id, text_vector, image_vector) through an explicit pair table (text_id, image_id)."""
    require(text, "id", vectors=("vector",))
    require(image, "id", vectors=("vector",))
    require(pairs, "text_id", "image_id")
    left = text.select(F.col("id").alias("text_id"), F.col("vector").alias("text_vector"))
    right = image.select(F.col("id").alias("image_id"), F.col("vector").alias("image_vector"))
    return pairs.join(left, "text_id").join(right, "image_id").select("text_id", "image_id", "text_vector", "image_vector")


def view_moments(pairs: DataFrame) -> DataFrame:
    """(i, j, total) of centred products over the concatenated views, i <= j; a task hands on one row of any size of view."""
    return moments.product_cells(moments.product_state(pairs))


def fit_correlation(pairs: DataFrame, reg: float = 1e-3, components: int | None = None, max_view: int = MAX_VIEW,
                    rank: int = RANK, least: float = LEAST_SHARE) -> Correlation:
    """Canonical correlation of paired views (text_vector, image_vector).

    The views are written once, executors add up means and products in one pass, and the driver solves the problem of the
    size of the two views together. Views of more than ``max_view`` entries together go to ``fit_wide`` with ``rank`` and ``least``. ``reg`` times the
    mean variance is added to each view's diagonal, since topic shares are linearly dependent.
    """
    pairs = written(pairs.select("text_vector", "image_vector"), "pairs")
    one = pairs.select(F.size("text_vector").alias("p"), F.size("image_vector").alias("q")).first()
    if one is None:
        raise ValueError("no pairs to fit on")
    if one["p"] + one["q"] > max_view:
        return fit_wide(pairs, reg, components, rank, least, max_rank=max_view // 2)
    (n, p), means, cells = moments.state_of(moments.product_state(pairs))
    p, width = int(p), len(means)
    cov = np.zeros((width, width))
    cov[np.triu_indices(width)] = cells / max(n - 1, 1)
    cov = cov + np.triu(cov, 1).T
    wt, wi, rho = solve_correlation(cov[:p, :p], cov[p:, p:], cov[:p, p:], reg)
    r = min(p, width - p) if components is None else min(components, p, width - p)
    return Correlation(means[:p], means[p:], wt[:, :r], wi[:, :r], rho[:r])


def fit_wide(pairs: DataFrame, reg: float = 1e-3, components: int | None = None, rank: int = RANK, least: float = LEAST_SHARE,
             passes: int = PASSES, max_rank: int = MAX_VIEW // 2, seed: int = 17) -> Correlation:
    """``fit_correlation`` for views of any width: within the directions of most variance of each view.

    Block power iteration (Halko, Martinsson and Tropp, 2011) finds an orthonormal basis of ``rank`` directions for each
    view; every pass multiplies it by the view's covariance, as sums over tasks of matrices as large as the basis. The
    pairs are then projected and solved as small views. When the bases hold less than ``least`` of either view's
    variance, the rank is doubled up to ``max_rank``; if that is still too little, ``ValueError`` tells the share. Views whose
    rank is no larger than the basis give the exact solution; others that of their leading directions. The driver holds
    matrices of (view x rank), never of (view x view).
    """
    pairs = written(pairs.select("text_vector", "image_vector"), "pairs")
    found = moments.state_of(moments.spread_state(pairs))
    if found is None:
        raise ValueError("no pairs to fit on")
    (n, p), means, squares = found
    p, n = int(p), int(n)
    traces = squares[:p].sum() / max(n - 1, 1), squares[p:].sum() / max(n - 1, 1)
    q = len(means) - p
    draw = np.random.default_rng(seed)
    while True:
        bases = tuple(np.linalg.qr(draw.standard_normal((size, min(rank, size))))[0] for size in (p, q))
        for _ in range(passes):
            products = moments.product_with(pairs, means, *bases)
            shares = [float((b * y).sum() / max(n - 1, 1) / t) if t > 0 else 1.0 for b, y, t in zip(bases, products, traces)]
            if min(shares) >= 1 - 1e-12:
                break
            bases = tuple(np.linalg.qr(y)[0] for y in products)
        if min(shares) >= least or rank >= max(p, q):
            break
        if rank >= max_rank:
            raise ValueError(f"{rank} directions hold {shares[0]:.4f} and {shares[1]:.4f} of the views' variance, less than {least}")
        rank = min(2 * rank, max_rank)
    small = projected_pairs(pairs, means, *bases)
    (_, l), _, cells = moments.state_of(moments.product_state(small))
    l, width = int(l), sum(b.shape[1] for b in bases)
    cov = np.zeros((width, width))
    cov[np.triu_indices(width)] = cells / max(n - 1, 1)
    cov = cov + np.triu(cov, 1).T
    ridges = reg * max(traces[0] / p, TINY), reg * max(traces[1] / q, TINY)
    wt, wi, rho = solve_correlation(cov[:l, :l], cov[l:, l:], cov[:l, l:], reg, ridges)
    r = min(len(rho), components or len(rho))
    wt, wi = signed(bases[0] @ wt[:, :r], bases[1] @ wi[:, :r])
    return Correlation(means[:p], means[p:], wt, wi, rho[:r])


def projected_pairs(pairs: DataFrame, means: np.ndarray, left: np.ndarray, right: np.ndarray) -> DataFrame:
    """Pairs with each view in the coordinates of its basis."""
    shipped = pairs.sparkSession.sparkContext.broadcast((means, left, right))

    def run(batches):
        means, left, right = shipped.value
        for batch in batches:
            both = (matrix(batch.column(0)) - means[:len(left)]) @ left, (matrix(batch.column(1)) - means[len(left):]) @ right
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel())) for x in both],
                ["text_vector", "image_vector"])

    return pairs.select("text_vector", "image_vector").mapInArrow(run, "text_vector array<double>, image_vector array<double>")


def solve_correlation(ctt: np.ndarray, cii: np.ndarray, cti: np.ndarray, reg: float, ridges: tuple[float, float] | None = None):
    """Whiten both views and take the singular vectors between them; the largest entry of each text vector is positive.

    Without ``ridges`` each view's ridge is ``reg`` times its mean variance.
    """
    def whiten(c, ridge):
        return np.linalg.inv(np.linalg.cholesky(c + ridge * np.eye(len(c)))).T
    ridges = ridges or tuple(reg * max(np.trace(c) / len(c), TINY) for c in (ctt, cii))
    a, b = whiten(ctt, ridges[0]), whiten(cii, ridges[1])
    u, rho, vt = np.linalg.svd(a.T @ cti @ b, full_matrices=False)
    return *signed(a @ u, b @ vt.T), np.clip(rho, 0, 1)


def signed(wt: np.ndarray, wi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sign = np.sign(wt[np.abs(wt).argmax(0), np.arange(wt.shape[1])])
    sign[sign == 0] = 1
    return wt * sign, wi[:, :wt.shape[1]] * sign


def project(items: DataFrame, mean: np.ndarray, weights: np.ndarray, id: str = "id", vector: str = "vector") -> DataFrame:
    """(id, vector) in the common space."""
    require(items, id, vectors=(vector,))

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            x = (matrix(batch.column(1)) - mean) @ weights if batch.num_rows else np.zeros((0, weights.shape[1]))
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=[id, "vector"])

    id_type = items.schema[id].dataType.simpleString()
    # a filter in the plan would go below the descriptors' projection, which would then be made twice
    return items.select(id, vector).mapInArrow(run, f"{id} {id_type}, vector array<double>")


def search_medium(projected: DataFrame, queries: DataFrame, categories: DataFrame | None = None, k: int = DEFAULT_K,
                  digits: int | None = None) -> DataFrame:
    """Best k items of one medium for projected queries of the other: (query_id, id, [category,] score, rank).

    The score is the normalised correlation of the two projections. ``categories`` is (id, category). Both sides are
    written first, so that descriptors are made once however often the search reads them.
    """
    near = nearest(written(projected, "projected"), written(queries, "queries"), k, "cosine", digits=digits)
    score = 1 - F.col("distance")
    found = near.select("query_id", "id", (F.round(score, digits) if digits is not None else score).alias("score"), "rank")
    if categories is None:
        return found
    named = found.join(categories.select("id", "category"), "id", "left")
    return named.select("query_id", "id", "category", "score", "rank")


def text_for_images(model: Correlation, texts: DataFrame, images: DataFrame, categories: DataFrame | None = None,
                    k: int = DEFAULT_K, digits: int | None = None) -> DataFrame:
    """Rank texts (id, vector) for query images (query_id, vector)."""
    return search_medium(project(texts, model.text_mean, model.text_weights),
                         project(images, model.image_mean, model.image_weights, "query_id"), categories, k, digits)


def images_for_texts(model: Correlation, images: DataFrame, texts: DataFrame, categories: DataFrame | None = None,
                     k: int = DEFAULT_K, digits: int | None = None) -> DataFrame:
    """Rank images (id, vector) for query texts (query_id, vector)."""
    return search_medium(project(images, model.image_mean, model.image_weights),
                         project(texts, model.text_mean, model.text_weights, "query_id"), categories, k, digits)


def correlation_table(model: Correlation, spark: SparkSession) -> DataFrame:
    """The model as one row per matrix, for saving."""
    rows = [(name, list(np.shape(part)), [float(x) for x in np.ravel(part)]) for name, part in model._asdict().items()]
    return spark.createDataFrame(rows, "part string, shape array<int>, cells array<double>")


def read_correlation(table: DataFrame) -> Correlation:
    parts = {r["part"]: np.array(r["cells"]).reshape(r["shape"]) for r in table.collect()}
    return Correlation(**parts)
