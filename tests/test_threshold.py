import numpy as np
from pyspark.sql import functions as F

from vestigo.operators import fusion, metric
from vestigo.operators.fusion import fused_batch, fused_threshold


def test_open_queries_get_all_pairs_instead_of_rankings_of_the_whole_collection(spark):
    draw = np.random.default_rng(8)
    rows = [(i, kind, [float(x) for x in draw.normal(size=12)]) for i in range(200) for kind in "ab"]
    rows += [(500, "a", [float("inf")] * 12), (501, "b", [1e200] * 12), (502, "a", None)]
    features = spark.createDataFrame(rows, "id bigint, kind string, vector array<double>")
    asked = features.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    found = fused_threshold(features, asked, ["a", "b"], [0.4, 0.6], 6, digits=6, depth=8, cell=10)
    whole = features.filter("id < 500")
    want = fused_batch(whole, asked, ["a", "b"], [0.4, 0.6], k=6, digits=6).filter("query_id < 500")
    columns = ["query_id", "id", "score", "rank"]
    assert sorted(map(tuple, found.found.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert found.rounds == 2  # before: rankings of 8, 32, 128 and all items


def test_blocks_hand_on_no_pair_beyond_a_querys_bound(spark):
    items = spark.createDataFrame([(0, 0, i, [float(i)]) for i in range(40)], "cell int, block int, item long, v array<double>")
    visits = spark.createDataFrame([(0, 0, 1, [10.0], 2.0, 40), (0, 0, 2, [10.0], None, 40)],
                                   "cell int, block int, query long, v array<double>, most double, n long")
    found = metric._met(items, visits, "l2", 64, 6).groupBy("query").agg(F.sort_array(F.collect_list("item")).alias("items"))
    assert {r["query"]: r["items"] for r in found.collect()} == {1: [8, 9, 10, 11, 12], 2: list(range(40))}


def test_rankings_that_score_nearly_every_pair_are_not_repeated(spark, monkeypatch):
    draw = np.random.default_rng(4)
    rows = [(i, kind, [float(x) for x in draw.standard_normal(24)]) for kind in ("front", "back") for i in range(600)]
    features = spark.createDataFrame(rows, "id bigint, kind string, vector array<double>")
    asked = features.filter("id % 60 = 0").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(fusion, "RANKED", 1)
    got = fusion.fused_threshold(features, asked, ["front", "back"], [0.5, 0.5], 3, digits=6, depth=4, growth=2, cell=16)
    want = fusion.fused_batch(features, asked, ["front", "back"], [0.5, 0.5], k=3, digits=6)
    assert got.rounds == 2  # without structure no cell is left out, so a second ranking would score all pairs again
    assert sorted(map(tuple, got.found.collect())) == sorted(map(tuple, want.collect()))
