"""Distance expressions between two array columns, and histogram conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "l1", "cosine", "chi2", "tanimoto")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: Column | str, b: Column | str, metric: str = "l2") -> Column:
    """Distance of two vectors of equal length, in double precision.

    Null when a side is null or the metric is undefined (cosine or tanimoto of zero vectors); unequal lengths raise.
    ``chi2`` and ``tanimoto`` are meant for histograms without negative entries.
    """
    raw_a, raw_b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    a, b = raw_a.cast("array<double>"), raw_b.cast("array<double>")
    if metric == "l2":
        value = F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
        apart = F.zip_with(a, b, lambda x, y: F.abs(x - y))
        most = F.array_max(apart)  # squares that overflow: the length of the difference, scaled by its largest entry
        scaled = most * F.sqrt(_total(F.transform(apart, lambda x: (x / most) * (x / most))))
        value = F.when(value == float("inf"), F.when(most == float("inf"), most).otherwise(scaled)).otherwise(value)
    elif metric == "l1":
        value = _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    elif metric == "cosine":
        norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
        value = F.when(norms != 0, 1 - _dot(a, b) / norms)
    elif metric == "chi2":
        value = _total(F.zip_with(
            a, b, lambda x, y: F.when(x + y != 0, (x - y) * (x - y) / (x + y)).otherwise(0.0)))
    elif metric == "tanimoto":
        dot = _dot(a, b)
        union = _dot(a, a) + _dot(b, b) - dot
        value = F.when(union != 0, 1 - dot / union)
    else:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    unequal = F.raise_error(F.concat(
        F.lit("vectors of unequal length: "), F.size(raw_a).cast("string"), F.lit(" and "), F.size(raw_b).cast("string")))
    return (F.when(raw_a.isNull() | raw_b.isNull(), F.lit(None).cast("double"))
            .when(F.size(raw_a) != F.size(raw_b), unequal.cast("double"))
            .otherwise(value))


def similarity(dist: Column | str) -> Column:
    """Similarity in (0, 1] of a distance."""
    dist = F.col(dist) if isinstance(dist, str) else dist
    return 1 / (1 + dist)


def slice_vector(vector: Column | str, start: int, length: int) -> Column:
    """Part of a vector, ``start`` counted from 1."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.slice(vector, start, length)


def histogram_string(bins: Column | str, first_bin: int = 1, prefix: str = "v") -> Column:
    """A dense histogram as blank-joined tokens: bin i, cut to an integer, repeats its token that often.

    Bin 0 gives no token unless ``first_bin=0``.
    """
    bins = F.col(bins) if isinstance(bins, str) else bins
    words = F.transform(bins, lambda n, i: F.when(
        i >= first_bin,
        F.array_repeat(F.concat(F.lit(prefix), i.cast("string")), F.greatest(n.cast("int"), F.lit(0)))
    ).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.flatten(words), " ")
