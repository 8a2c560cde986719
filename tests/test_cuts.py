"""Cuts that must not change results: rankings of many queries at any k, searches that skip blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vestigo.operators import search
from vestigo.operators.ranking import WINDOW_CUT, cut_in_tasks, top_k
from vestigo.operators.terms import document_norms
from vestigo.sources import bounds, tables
from tests.test_text import brute

NAN = float("nan")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hold", [1 << 20, 50])
def test_rows_cut_in_tasks_hold_the_best_of_each_group(spark, hold):
    draw = random.Random(2)
    rows = [(draw.choice(["a", "b", "é", None]), draw.choice([1.5, 2.0, NAN, None, float("inf"), -0.0, draw.random()]), draw.choice(["x", "y", None]), i)
            for i in range(900)]
    df = spark.createDataFrame(rows, "g string, score double, name string, id bigint").repartition(5)
    for order in ([("score", "descending"), ("id", "ascending")], [("score", "ascending"), ("name", "descending"), ("id", "descending")]):
        for k in (1, 7, 400):
            cut = cut_in_tasks(df, k, order, ["g"], hold)
            want = sorted(map(repr, top_k(df, k, order, ["g"]).collect()))
            assert sorted(map(repr, top_k(cut, k, order, ["g"]).collect())) == want
            if hold > 900 and k == 7:
                assert cut.count() <= 4 * 7 * 5
    assert cut_in_tasks(df.limit(0), 3, [("id", "ascending")], ["g"]).count() == 0


def test_deep_rankings_of_several_queries(spark):
    docs = [(i, "x " + "y " * (i % 50) + "z" * (i % 3)) for i in range(6000)]
    queries = [(1, "x y"), (2, "y"), (3, "x zz")]
    left, right = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(queries, "query_id bigint, text string")
    k = 2000
    assert k > WINDOW_CUT
    want = brute(docs, queries, k)
    index = tables.save_index(left, tables.fresh_path(spark, "index"), buckets=2)
    terms = search.query_terms(right)
    for found in (search.search_texts(left, right, k), search.search_postings(index.postings, terms, k)):
        assert "MapInArrow" in plan_of(found) or "PythonMapInArrow" in plan_of(found)
        assert sorted(map(tuple, found.collect())) == want
    weighted = search.search_weighted(index, terms, k)
    assert "MapInArrow" in plan_of(weighted)
    assert {r["query_id"]: r["n"] for r in weighted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: k, 2: k, 3: k}


@pytest.fixture(scope="module")
def zipf():
    draw = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    docs = [(i, " ".join(draw.choices(words, weights, k=200 if i % 20 == 0 else draw.choice([3, 5, 8, 12])))) for i in range(1500)]
    return docs + [(5000, ""), (5001, "w0 w0"), (5002, "w0 w0"), (-3, "w0 w1")]


@pytest.mark.parametrize("width, rare, first", [(64, 16, 2), (8, 1, 1), (4096, 10 ** 9, 16)])
def test_bounded_search_is_exact_and_reads_less(spark, zipf, width, rare, first):
    docs = spark.createDataFrame(zipf, "doc_id bigint, text string")
    index = tables.save_index(docs, tables.fresh_path(spark, "index"), buckets=4)
    path = tables.fresh_path(spark, "bounds")
    bounds.save_bounds(index, path, width, rare)
    held = bounds.load_bounds(spark, path, index)
    queries = [(1, "w0 w1 w1"), (2, "w150"), (3, "none"), (4, "w0 w3 w199 w20")]
    terms = search.query_terms(spark.createDataFrame(queries, "query_id bigint, text string"))
    found = search.search_bounded(held, terms, 5, first=first)
    assert sorted(map(tuple, found.collect())) == brute(zipf, queries, 5)
    assert sorted(map(tuple, search.search_bounded(held, terms, 5, True, first=first).collect())) == sorted(
        map(tuple, search.search_weighted(index, terms, 5).collect()))
    cost = {r["query_id"]: (r["matched"], r["scored"]) for r in search.bounded_plan(held, terms, 5, first=first).cost.collect()}
    assert set(cost) == {1, 2, 4} and all(scored <= matched for matched, scored in cost.values())
    if width == 64:
        assert cost[1][1] < cost[1][0] / 2 and cost[4][1] < cost[4][0] / 2
    deep = search.search_bounded(held, terms, 3000, first=first)
    assert sorted(map(tuple, deep.collect())) == brute(zipf, queries, 3000)


def test_bounds_of_named_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "x x"), ("c", "")], "name string, text string")
    index = tables.save_index(docs, tables.fresh_path(spark, "index"), "name", buckets=2)
    path = tables.fresh_path(spark, "bounds")
    bounds.save_bounds(index, path, 2, 1)
    terms = search.query_terms(spark.createDataFrame([(1, "x")], "query_id bigint, text string"))
    found = search.search_bounded(bounds.load_bounds(spark, path, index), terms, 5)
    assert [(r["name"], r["score"]) for r in found.orderBy("rank").collect()] == [("b", 2), ("a", 1)]
    none = terms.limit(0)
    assert search.search_bounded(bounds.load_bounds(spark, path, index), none, 5).count() == 0


def test_bounds_written_in_slices_hold_every_posting_once(spark, zipf):
    docs = spark.createDataFrame(zipf, "doc_id bigint, text string")
    index = tables.save_index(docs, tables.fresh_path(spark, "index"), buckets=4)
    whole, sliced = tables.fresh_path(spark, "bounds"), tables.fresh_path(spark, "bounds")
    bounds.save_bounds(index, whole, 64, 16)
    bounds.save_bounds(index, sliced, 64, 16, ship_bytes=20_000)
    one, many = bounds.load_bounds(spark, whole, index), bounds.load_bounds(spark, sliced, index)
    assert sorted(map(str, one.postings.collect())) == sorted(map(str, many.postings.collect()))
    want = one.postings.join(index.terms.filter("df >= 16"), "term", "left_semi").groupBy("term", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("tf"), F.max("share").alias("share"))
    queries = [(1, "w0 w1 w1"), (2, "w150"), (4, "w0 w3 w199 w20")]
    terms = search.query_terms(spark.createDataFrame(queries, "query_id bigint, text string"))
    for held in (one, many):
        found = held.maxima.groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("tf").alias("tf"), F.max("share").alias("share"))
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
        assert sorted(map(tuple, search.search_bounded(held, terms, 5).collect())) == brute(zipf, queries, 5)


def test_norms_shuffle_postings_of_rare_terms_only(spark, zipf):
    docs = spark.createDataFrame(zipf, "doc_id bigint, text string")
    index = tables.save_index(docs, tables.fresh_path(spark, "index"), buckets=4)
    plain = {r["doc_id"]: r["norm"] for r in document_norms(index.postings, index.terms, index.docs).collect()}
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as when documents and terms are many
    try:
        for most, joins in ((1 << 18, 1), (50, 2), (0, 2)):
            norms = document_norms(index.postings, index.terms, index.docs, most=most)
            assert {r["doc_id"]: r["norm"] for r in norms.collect()} == pytest.approx(plain)
            assert plan_of(norms).split("Initial Plan")[-1].count("SortMergeJoin") == joins  # the last of them brings norms to documents
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
