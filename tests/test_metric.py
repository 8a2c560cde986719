"""Nearest neighbours with cells left out, against the exact search of all pairs."""

import numpy as np
import pytest

from vestigo.operators.distances import nearest
from vestigo.operators.fusion import fused_batch, fused_threshold
from vestigo.operators.metric import nearest_pruned

SCHEMA = "id bigint, vector array<double>"


def both(spark, items, asked, k, metric, **settings):
    left = spark.createDataFrame(items, SCHEMA)
    right = spark.createDataFrame(asked, SCHEMA.replace("id", "query_id"))
    found = nearest_pruned(left, right, k, metric, digits=6, **settings)
    got = sorted(map(tuple, found.found.select("query_id", "id", "distance", "rank").collect()))
    want = sorted(map(tuple, nearest(left, right, k, metric, digits=6).select("query_id", "id", "distance", "rank").collect()))
    return got, want, found.scored.first()[0], found.all_pairs


@pytest.mark.parametrize("metric", ["l2", "l1", "cosine"])
def test_clustered_vectors_score_few_pairs(spark, metric):
    draw = np.random.default_rng(4)
    centres = 20 * draw.normal(size=(30, 6))
    items = [(i, [float(x) for x in centres[i % 30] + draw.normal(size=6)]) for i in range(900)]
    items += [(2000 + i, items[i][1]) for i in range(40)]  # ties
    asked = [(i, items[i * 7][1]) for i in range(60)] + [(100, [1.0] * 6)]
    got, want, scored, pairs = both(spark, items, asked, 12, metric, cell=30, block=16)
    assert got == want
    assert pairs == 940 * 61 and scored < pairs / 3


@pytest.mark.parametrize("k, cell, block", [(1, 10, 7), (300, 20, 50), (5, 1000, 1000)])
def test_vectors_without_clusters_are_exact(spark, k, cell, block):
    draw = np.random.default_rng(5)
    items = [(i, [float(x) for x in draw.integers(0, 4, 3)]) for i in range(200)]
    got, want, scored, pairs = both(spark, items, items[:30], k, "l2", cell=cell, block=block)
    assert got == want and scored <= pairs


def test_odd_vectors(spark):
    items = [(1, [0.0, 0.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [1.0, 1.0]), (6, [None, 1.0]), (7, [-1.0, 1.0])]
    asked = [(1, [1.0, 0.5]), (2, None), (3, [0.0, 0.0])]
    left, right = spark.createDataFrame(items, SCHEMA), spark.createDataFrame(asked, SCHEMA.replace("id", "query_id"))
    ids = lambda metric: sorted((r["query_id"], r["id"]) for r in nearest_pruned(left, right, 9, metric).found.collect())
    assert ids("l2") == [(q, i) for q in (1, 3) for i in (1, 5, 7)]
    assert ids("cosine") == [(1, 5), (1, 7)]
    assert nearest_pruned(left.limit(0), right, 3).found.count() == 0
    assert nearest_pruned(left, right.limit(0), 3).found.count() == 0
    with pytest.raises(ValueError):
        nearest_pruned(left, right, 3, "chi2")


@pytest.mark.parametrize("depth, weights", [(20, [0.5, 0.5]), (5, [0.9, 0.1]), (400, [0.3, 0.7])])
def test_fusion_by_threshold_equals_scoring_all(spark, depth, weights):
    draw = np.random.default_rng(6)
    centres = 30 * draw.normal(size=(20, 4))
    rows = []
    for i in range(300):
        for kind, shift in (("a", 0), ("b", 7)):
            v = [float(x) for x in centres[(i + shift * (i % 2)) % 20] + draw.normal(size=4)]
            if i % 31 != 3 or kind == "a":
                rows.append((i, kind, v if i % 37 != 5 else None))
    rows += [(1000 + i, k, v) for i, k, v in rows[:40]]
    features = spark.createDataFrame(rows, "id bigint, kind string, vector array<double>")
    asked = features.filter("id % 29 = 3").withColumnRenamed("id", "query_id")
    found = fused_threshold(features, asked, ["a", "b"], weights, 7, digits=6, depth=depth, cell=20)
    want = fused_batch(features, asked, ["a", "b"], weights, k=7, digits=6)
    columns = ["query_id", "id", "score", "rank"]
    assert sorted(map(tuple, found.found.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    if depth == 20:
        assert found.scored < 2 * 320 * asked.select("query_id").distinct().count() / 2
    with pytest.raises(ValueError):
        fused_threshold(features, asked, ["a"], [-1.0])
