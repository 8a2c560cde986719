import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from vestigo.functions.text import WORD_BREAKS, base_name, one_line, page_text, page_title, tokens
from vestigo.operators import refresh, search, terms
from vestigo.operators.ranking import ids, keep, merge_top, scored, sort_by_distance, top_k, in_top
from vestigo.sources import tables


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def saved(docs):
    return tables.save_index(docs, tables.fresh_path(docs.sparkSession, "index"), buckets=4)


def tok(text):
    return [t for t in text.lower().split(" ") if t]


def brute(docs, queries, k):
    out = []
    for qid, qtext in queries:
        q = collections.Counter(tok(qtext))
        scores = []
        for did, text in docs:
            d = collections.Counter(tok(text))
            score = sum(n * d[t] for t, n in q.items())
            if any(t in d for t in q):
                scores.append((-score, did))
        out += [(qid, did, -s, i + 1) for i, (s, did) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def collection():
    random.seed(5)
    words = ["the"] * 20 + ["And", "ROSE", "lily", "x", "y\nz", "über", "end.", "end"]
    docs = [(i, " ".join(random.choices(words, k=random.randint(0, 30)))) for i in range(120)]
    docs += [(200 + i, docs[7][1]) for i in range(15)] + [(300, ""), (301, "   "), (302, " the  lily ")]
    queries = [(i, " ".join(random.choices(words, k=5))) for i in range(40)] + [(50, "unknownterm"), (51, "")]
    return docs, queries


@pytest.mark.parametrize("text, want", [
    ("", []), ("   ", []), ("A  b ", ["a", "b"]), (" a", ["a"]), ("a\nb c.", ["a\nb", "c."]), (None, None),
])
def test_tokens(spark, text, want):
    assert frame(spark, [(1, text)]).select(tokens("text").alias("t")).first()["t"] == want


def test_word_tokens_and_stop_words(spark):
    row = frame(spark, [(1, "The cat, the HAT; a-b")])
    assert row.select(tokens("text", WORD_BREAKS, ["the", "a"]).alias("t")).first()["t"] == ["cat", "hat", "b"]


def test_term_tables(spark):
    docs = frame(spark, [(1, "a b a"), (2, "b"), (3, "")])
    postings = terms.term_frequencies(docs)
    assert sorted(map(tuple, postings.collect())) == [("a", 1, 2), ("b", 1, 1), ("b", 2, 1)]
    assert sorted(map(tuple, terms.document_frequencies(postings).collect())) == [("a", 1), ("b", 2)]
    index = saved(docs)
    assert {r["doc_id"]: r["length"] for r in index.docs.collect()} == {1: 3, 2: 1, 3: 0}
    idf = {r["term"]: r["idf"] for r in index.terms.collect()}
    assert idf["a"] == pytest.approx(math.log(3)) and idf["b"] == pytest.approx(math.log(1.5))


def test_posting_segments_join_to_newest_first_lists(spark):
    docs = frame(spark, [(i, "hot" + (" rare" if i == 7 else "")) for i in range(25)])
    segments = terms.posting_segments(terms.term_frequencies(docs), 10).orderBy(F.desc("segment")).collect()
    hot = [s for s in segments if s["term"] == "hot"]
    assert [p["doc_id"] for s in hot for p in s["postings"]] == list(range(24, -1, -1))
    assert max(len(s["postings"]) for s in segments) == 10


def test_searches_agree_with_brute_force(spark, collection):
    docs, queries = collection
    d, q = frame(spark, docs), frame(spark, queries, "query_id bigint, text string")
    want = brute(docs, queries, 10)
    for parts in (1, 16):
        split = d.repartition(parts)
        assert sorted(map(tuple, search.search_texts(split, q).collect())) == want
        assert sorted(map(tuple, search.search_batch(split, q).collect())) == want
    found = search.search_postings(terms.term_frequencies(d), search.query_terms(q))
    assert sorted(map(tuple, found.collect())) == want


def test_batch_search_with_each_way_of_placing_the_sides(spark, collection):
    docs, queries = collection
    d, q = frame(spark, docs), frame(spark, queries, "query_id bigint, text string")
    want = brute(docs, queries, 3)
    few = frame(spark, docs[:8])
    assert sorted(map(tuple, search.search_batch(few, q, 3, ship_bytes=1200).collect())) == brute(docs[:8], queries, 3)
    assert sorted(map(tuple, search.search_batch(d, q, 3, ship_bytes=700, block_bytes=900).collect())) == want


def test_count_scores_in_small_pieces(spark, collection):
    docs, queries = collection
    import numpy as np
    import pyarrow as pa
    q = pa.table({"tokens": pa.array([tok(t) for _, t in queries], pa.list_(pa.string()))})
    d = pa.table({"tokens": pa.array([tok(t) for _, t in docs], pa.list_(pa.string()))})
    whole = np.concatenate([s for _, s in search.count_scores(search.query_counts(q), d)], axis=1)
    pieces = np.concatenate([s for _, s in search.count_scores(search.query_counts(q), d, cells=97)], axis=1)
    np.testing.assert_array_equal(whole, pieces)


def test_string_ids_and_empty_collections(spark):
    docs = frame(spark, [("b", "x y"), ("a", "x"), ("c", "z")], "doc_id string, text string")
    q = frame(spark, [("q", "x")], "query_id string, text string")
    want = [("q", "a", 1, 1), ("q", "b", 1, 2)]
    assert sorted(map(tuple, search.search_batch(docs, q).collect())) == want
    assert search.search_batch(docs.limit(0), q).count() == 0
    assert search.search_texts(docs, q.limit(0)).count() == 0


def test_weighted_search(spark):
    docs = [(1, "a b a"), (2, "b c"), (3, "c c c"), (4, "b b a")]
    index = saved(frame(spark, docs))
    q = frame(spark, [(9, "a a c")], "query_id bigint, text string")
    n, df = len(docs), {"a": 2, "b": 3, "c": 2}
    idf = {t: math.log(n / f) for t, f in df.items()}
    want = {}
    for i, text in docs:
        norm = math.sqrt(sum(idf[t] ** 2 for t in tok(text)))
        score = sum(text.split().count(t) * idf[t] ** 2 for t in ["a", "a", "c"])
        if score:
            want[i] = score / norm
    got = {r["doc_id"]: r["score"] for r in search.search_weighted(index, search.query_terms(q)).collect()}
    assert got == pytest.approx(want)


def test_weighted_search_drops_documents_without_norm(spark):
    # every document holds the only term, so idf and norms are 0 and scores undefined
    index = saved(frame(spark, [(1, "a"), (2, "a a")]))
    q = frame(spark, [(9, "a")], "query_id bigint, text string")
    assert search.search_weighted(index, search.query_terms(q)).count() == 0


def test_refresh_equals_rebuild(spark):
    old = frame(spark, [(1, "a b"), (2, "b c"), (3, "gone"), (5, "same same")])
    new = frame(spark, [(1, "a b"), (2, "changed c"), (4, "added"), (5, "same same")])
    stored, postings = refresh.content_hashes(old), terms.term_frequencies(old)
    got = refresh.refresh_postings(postings, stored, new)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, terms.term_frequencies(new).collect()))
    assert {r["doc_id"] for r in refresh.changed_docs(new, stored).collect()} == {2, 4}
    assert {r["doc_id"] for r in refresh.gone_docs(new, stored).collect()} == {2, 3}
    assert refresh.changed_docs(old, stored).count() == 0


def test_scores_without_value_are_dropped_before_ranking(spark):
    rows = [(i, s) for i, s in enumerate([8.1, 3.5, 4.6, 7.8, float("nan"), None], 1)]
    best = top_k(scored(frame(spark, rows, "id int, score double")), 3, [("score", "descending"), ("id", "ascending")])
    assert [r["id"] for r in best.orderBy("rank").collect()] == [1, 4, 3]
    assert [r["id"] for r in ids(best).collect()] == [1, 4, 3]


@pytest.mark.parametrize("per", [(), ("g",)])
def test_top_k_in_one_or_two_levels(spark, per):
    random.seed(1)
    rows = [(i, i % 3 if per else 0, float(random.randint(0, 9))) for i in range(400)]
    df = frame(spark, rows, "id bigint, g int, score double").repartition(7)
    order = [("score", "descending"), ("id", "ascending")]
    want = []
    for g in {r[1] for r in rows}:
        best = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[:25]
        want += [(*r, n + 1) for n, r in enumerate(best)]
    for levels in (1, 2):
        assert sorted(map(tuple, top_k(df, 25, order, per, levels=levels).collect())) == sorted(want)
    assert top_k(df.limit(0), 25, order, per).count() == 0
    assert top_k(df, 0, order, per).count() == 0


def test_sort_words_and_order(spark):
    df = frame(spark, [(1, 2.0), (2, None), (3, 1.0), (4, 2.0)], "id int, distance double")
    assert [r["id"] for r in sort_by_distance(df).collect()] == [3, 1, 4, 2]
    assert [r["id"] for r in sort_by_distance(df, "descending").collect()] == [1, 4, 3, 2]
    with pytest.raises(ValueError):
        sort_by_distance(df, "upwards")


def test_merge_keeps_repeats_and_filters(spark):
    a = frame(spark, [(1, 5.0), (2, 4.0)], "id int, score double")
    merged = merge_top([a, a], 3, [("score", "descending"), ("id", "ascending")])
    assert [(r["id"], r["score"]) for r in merged.orderBy("rank").collect()] == [(1, 5.0), (1, 5.0), (2, 4.0)]
    assert keep(a, F.col("score") > 4).count() == 1
    twice = frame(spark, [(1,), (1,), (3,)], "id int")
    assert in_top(twice, a.union(a)).count() == 2


def test_paths_and_markup(spark):
    row = frame(spark, [(1, "s3a://b/dir.x/a-3.xml")])
    assert row.select(base_name("text")).first()[0] == "a-3"
    assert frame(spark, [(1, "http://h/p/name.html?x=1#t")]).select(base_name("text")).first()[0] == "name"
    assert frame(spark, [(1, "a\n\nb\n")]).select(one_line("text")).first()[0] == "a  b"
    html = "<head><title>A &amp; B</title></head><body><script>no()</script><p>One<br>two</p><!-- x --></body>"
    page = frame(spark, [(1, html)])
    assert page.select(page_title("text")).first()[0] == "A & B"
    assert page.select(page_text("text")).first()[0].split() == ["One", "two"]


def test_posting_segments_of_large_and_named_ids(spark):
    rows = spark.createDataFrame([("t", (1 << 60) - 1, 1), ("t", 1 << 60, 1), ("t", -1, 1)], "term string, doc_id bigint, tf bigint")
    found = {r["segment"]: [p["doc_id"] for p in r["postings"]] for r in terms.posting_segments(rows, 256).collect()}
    assert found == {(1 << 52) - 1: [(1 << 60) - 1], 1 << 52: [1 << 60], -1: [-1]}
    named = spark.createDataFrame([("t", "x", 1), ("t", "y", 2)], "term string, doc_id string, tf bigint")
    assert sum(len(r["postings"]) for r in terms.posting_segments(named, 4).collect()) == 2


@pytest.mark.parametrize("k", [10, 2000])
def test_deep_rankings_are_cut_in_the_tasks(spark, k):
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('x ', repeat('y ', cast(id % 50 as int))) as text")
    query = spark.createDataFrame([(1, "x y")], "query_id bigint, text string")
    found = search.search_texts(docs, query, k)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan or "WindowGroupLimit" in plan
    assert found.count() == k
    assert found.first()["score"] == 50
