"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from vestigo import plans
from tests.check_queries import database, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query_agrees(spark, con, name):
    problem, rows, _ = difference(spark, con, FOLDER, name)
    assert problem is None
    assert rows > 0


def test_entry(spark):
    found = entry_points.entry(spark)
    assert found.columns == ["query_id", "doc_id", "score", "rank"]
    assert found.count() == 10


def test_sql_names_are_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_rows_only_queries_are_the_trained_ones():
    assert set(plans.QUERIES) - set(plans.SQL) == {
        "kmeans_hist", "bovw_kmeans", "crossmodal_cca", "crossmodal_cca_images", "topics"}


@pytest.mark.parametrize("name", [
    "search_count", "search_postings", "nearest_l2", "sort_limit", "filter_top", "codebook_assign", "fusion", "fusion_all",
    "fusion_batch", "fusion_lists", "union_merge", "cascade", "pair_views", "crossmodal_fixed"])
def test_plans_neither_sort_everything_nor_pair_rows(spark, name):
    plan = entry_points.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
