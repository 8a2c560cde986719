"""Matching of many queries: candidates stay few however many tasks there are, and pruned pairs change no result."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vestigo.operators import blocks, crossmodal, fusion, search
from vestigo.operators.distances import boxed_cosine, distance_scores, near_pairs, nearest
from vestigo.plans import media


def vectors(spark, rows, name):
    table = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)]
    return spark.createDataFrame(table, f"{name} bigint, vector array<double>")


def test_candidates_do_not_grow_with_the_tasks_of_the_collection(spark):
    draw = np.random.default_rng(3)
    items = vectors(spark, draw.standard_normal((400, 4)), "id").repartition(20)
    asked = items.withColumnRenamed("id", "query_id")
    size, k = F.lit(32), 200  # queries times k are more than a task may hand on

    def scorer(q, c, best):
        return near_pairs(q.column("vector"), c.column("vector"), "l2", None, best)

    found = blocks.best_k(asked, items, k, scorer, query_id="query_id", id="id", query_size=size, corpus_size=size)
    assert found.count() == 400 * k
    cut = blocks.best_k(asked, items, k, scorer, query_id="query_id", id="id", query_size=size, corpus_size=size, ship_bytes=9000)
    assert 400 * k <= cut.count() <= 2 * 400 * k


def test_a_grid_over_one_frame_on_both_sides(spark):
    items = vectors(spark, np.random.default_rng(4).standard_normal((120, 4)), "id")
    asked = items.withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, nearest(items, asked, 3, digits=6).collect()))
    assert sorted(map(tuple, nearest(items, asked, 3, digits=6, ship_bytes=900, block_bytes=2000, hold_rows=90).collect())) == want


def test_a_grid_keeps_its_bounds():
    assert blocks.grid(36, 1, 1, 1, 1) == (6, 6)
    for q_least, c_least, q_bytes, c_bytes in ((5, 1, 1e9, 1e8), (1, 24, 1e6, 1e10), (7, 9, 1, 1), (1, 1, 0, 0)):
        q, c = blocks.grid(36, q_least, c_least, q_bytes, c_bytes)
        assert q >= q_least and c >= c_least and q * c >= 36


def test_cells_are_dealt_to_all_partitions_in_turn(spark):
    for cells in (5, 8, 20):
        keys = blocks.cell_keys(spark, cells)
        assert len(set(keys)) == cells
        rows = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(8, "k").groupBy(F.spark_partition_id()).count().collect()
        assert len(rows) == min(cells, 8) and max(r["count"] for r in rows) <= -(-cells // 8)


@pytest.mark.parametrize("metric", ["l2", "cosine", "l1", "tanimoto"])
@pytest.mark.parametrize("digits", [None, 3])
def test_pairs_in_question_hold_the_best(metric, digits):
    draw = np.random.default_rng(5)
    a, b = draw.standard_normal((30, 6)), draw.standard_normal((900, 6))
    b[100:160] = b[:60]
    b[7], b[8, 2], b[9, 3], a[3], a[4, 1] = 0, np.nan, np.inf, 0, np.nan
    q, c = (pa.chunked_array([pa.array(list(x), pa.list_(pa.float64()))]) for x in (a, b))
    ids, whole = pa.array(np.arange(900)[::-1].copy()), blocks.BestK(30, 10, pa.int64())
    for first, scores in distance_scores(q, c, metric, 1 << 62, digits):
        whole.offer(scores, ids.slice(first, scores.shape[1]))
    want = whole.settle().to_pydict()
    best = blocks.BestK(30, 10, pa.int64())
    for at in range(0, 900, 150):
        for who, row, scores in near_pairs(q, c.slice(at, 150), metric, digits, best):
            best.add(who, scores, ids.slice(at, 150).take(pa.array(row)))
    got = best.settle().to_pydict()
    assert got["q"] == want["q"] and np.allclose(got["s"], want["s"], atol=1e-9)
    assert digits is None or got["id"] == want["id"]


@pytest.mark.parametrize("kind", ["spread", "ties", "constant", "large"])
def test_l1_is_computed_for_few_pairs_and_none_is_missed(kind, monkeypatch):
    draw = np.random.default_rng(9)
    b = draw.standard_normal((3000, 48))
    if kind == "ties":
        b = np.round(np.abs(b) * (draw.random(b.shape) < 0.3))  # mostly zeros, whole numbers
    elif kind == "constant":
        b[:, 7:] = 3.0
    elif kind == "large":
        b[5] *= 1e12
    a = b[::100] + (0 if kind == "ties" else 0.01)
    q, c = (pa.chunked_array([pa.array(list(x), pa.list_(pa.float64()))]) for x in (a, b))
    ids, every = pa.array(np.arange(3000)[::-1].copy()), blocks.BestK(30, 10, pa.int64())
    for first, scores in distance_scores(q, c, "l1", 10, 6):
        every.offer(scores, ids.slice(first, scores.shape[1]))
    best, taken = blocks.BestK(30, 10, pa.int64()), 0
    for who, row, scores in near_pairs(q, c, "l1", 6, best):
        best.add(who, scores, ids.take(pa.array(row)))
        taken += len(who)
    assert best.settle().to_pydict() == every.settle().to_pydict()
    assert kind in ("ties", "large") or taken < 30 * 3000 / 10


@pytest.mark.parametrize("rows", [5, 90, 9000])
@pytest.mark.parametrize("k", [1, 10, 100])
def test_short_vectors_are_looked_up_in_boxes(rows, k, monkeypatch):
    draw = np.random.default_rng(10)
    b = np.array([2.0, -1, 0.5, 1]) + 0.3 * draw.standard_normal((rows, 4))
    a = np.vstack([draw.standard_normal((40, 4)), b[:40]])
    b[rows // 2:rows // 2 + rows // 10] = b[0]
    b[1], b[2, 1], b[3, 0], a[3], a[4, 1] = 0, np.nan, np.inf, 0, np.nan
    q, c = (pa.chunked_array([pa.array(list(x), pa.list_(pa.float64()))]) for x in (a, b))
    ids, every = pa.array(np.arange(rows)[::-1].copy()), blocks.BestK(len(a), k, pa.int64())
    for who, row, scores in near_pairs(q, c, "cosine", 6, every):
        every.add(who, scores, ids.take(pa.array(row)))
    looked, einsum = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda *x: (looked.append(x[2].size // 4), einsum(*x))[1])
    best = blocks.BestK(len(a), k, pa.int64())
    for who, row, scores in boxed_cosine(c, "vector", 6)(pa.table({"vector": q}), best):
        best.add(who, scores, ids.take(pa.array(row)))
    assert best.settle().to_pydict() == every.settle().to_pydict()
    assert rows < 9000 or k > 10 or sum(looked) < len(a) * rows / 3


def test_short_vectors_without_a_usable_one(spark):
    items = vectors(spark, [None, [0, 0], [float("nan"), 1]], "id")
    assert nearest(items, items.withColumnRenamed("id", "query_id"), 2, "cosine", ship_bytes=1).count() == 0
    some = vectors(spark, np.random.default_rng(11).standard_normal((300, 3)), "id")
    asked = some.withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, nearest(some, asked, 3, "cosine", digits=6).collect()))
    for bounds in ({"ship_bytes": 900, "block_bytes": 4000, "hold_rows": 90}, {"hold_rows": 300}):
        assert sorted(map(tuple, nearest(some, asked, 3, "cosine", digits=6, **bounds).collect())) == want


def test_vectors_too_long_to_square_keep_their_neighbours(spark):
    items = vectors(spark, [[1e200, 0], [1e200, 1e190], [0, 1], [1e-200, 0], None, [0, 0]], "id")
    asked = items.withColumnRenamed("id", "query_id")
    found = {(r["query_id"], r["rank"]): r["id"] for r in nearest(items, asked, 2, "l2").collect()}
    assert found[0, 1] == 0 and found[0, 2] == 1 and found[5, 1] == 3 and found[5, 2] == 5 or found[5, 1] == 5


def test_fused_pairs_agree_with_every_pair_scored(spark):
    draw = np.random.default_rng(8)
    front, back = draw.standard_normal((300, 3)), draw.standard_normal((300, 5))
    rows = [(i, kind, None if (i + at) % 37 == 0 else [float(x) for x in v[i]])
            for at, (kind, v) in enumerate((("front", front), ("back", back))) for i in range(300) if (i + at) % 41]
    features = spark.createDataFrame(rows, "id bigint, kind string, vector array<double>")
    got = fusion.fused_batch(features, features.withColumnRenamed("id", "query_id"), ["front", "back"], [0.3, 0.7], digits=6)
    held = {(i, kind): np.array(v) for i, kind, v in rows if v is not None}
    want = []
    for q in range(300):
        scores = []
        for d in range(300):
            near = [w / (1 + round(float(np.linalg.norm(held[q, kind] - held[d, kind])), 6)) for kind, w in (("front", 0.3), ("back", 0.7))
                    if (q, kind) in held and (d, kind) in held]
            if near:
                scores.append((-round(sum(near), 6), d))
        want += [(q, d, rank) for rank, (_, d) in enumerate(sorted(scores)[:10], 1)]
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got.collect()) == sorted(want)


def test_common_terms_are_counted_as_a_product():
    draw = np.random.default_rng(2)
    def lists(n):
        return pa.table({"tokens": pa.array([[f"w{x}" for x in draw.zipf(1.4, 30) if x < 3000] for _ in range(n)], pa.list_(pa.string()))})
    q, d = lists(40), lists(50)
    got = np.concatenate([s for _, s in search.count_scores(search.query_counts(q), d, cells=900)], axis=1)
    for i, left in enumerate(q["tokens"].to_pylist()):
        for j, right in enumerate(d["tokens"].to_pylist()):
            total = sum(left.count(t) * right.count(t) for t in set(left))
            assert total == (0 if np.isnan(got[i, j]) else got[i, j])


def test_long_documents_first_leave_most_pairs_unscored(monkeypatch):
    draw = np.random.default_rng(6)
    def lists(sizes):
        return pa.table({"tokens": pa.array([[f"w{x}" for x in draw.zipf(1.5, n)] for n in sizes], pa.list_(pa.string()))})
    q, d = lists([12] * 59 + [0]), lists(np.maximum(draw.pareto(0.8, 3000) * 5, 0).astype(int) % 4000)
    ids, cells = pa.array(np.arange(3000)[::-1].copy()), []
    d = d.append_column("id", ids)
    every = blocks.BestK(60, 5, pa.int64())
    for first, scores in search.count_scores(search.query_counts(q), d):
        every.offer(scores, ids.slice(first, scores.shape[1]))
    scored = search._scored_block
    monkeypatch.setattr(search, "CELLS", 4000)
    monkeypatch.setattr(search, "_scored_block", lambda left, code, row, tf, width, *more: (
        cells.append(left.n * width), scored(left, code, row, tf, width, *more))[1])
    best = blocks.BestK(60, 5, pa.int64())
    for who, at, scores in search.whole_counts(d)(q, best):
        best.add(who, scores, ids.take(pa.array(at)))
    assert best.settle().to_pydict() == every.settle().to_pydict()
    assert sum(cells) < 60 * 3000 / 3


def test_descriptors_are_made_once_for_a_projection(spark):
    calls = spark.sparkContext.accumulator(0)

    def double(v):
        calls.add(len(v))
        return pa.array([None if x is None else [float(x), 1.0] for x in v.to_pylist()], pa.list_(pa.float64()))

    rows = spark.createDataFrame([(i, None if i == 3 else i) for i in range(20)], "id bigint, x bigint")
    items = rows.select("id", F.arrow_udf(double, "array<double>")("x").alias("vector"))
    got = crossmodal.project(items, np.zeros(2), np.eye(2)).collect()
    assert sorted(r["id"] for r in got) == [i for i in range(20) if i != 3] and calls.value == 20


def test_shares_of_character_classes():
    low, length = pa.array(["abab, 1", "", None, "é1"]), pa.array([7, 0, None, 2])
    assert media._class_shares(low, length).to_pylist() == [
        [2 / 7, 2 / 7, 0, 0, 0, 1 / 7, 1 / 7, 1 / 7], [0.0] * 8, [None] * 8, [0, 0, 0, 0, 0, 0.5, 0, 0]]
