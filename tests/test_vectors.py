import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vestigo.functions.vectors import METRICS, distance, histogram_string
from vestigo.operators import crossmodal, features, fusion, models, moments, search
from vestigo.operators.distances import feature_distance, nearest
from vestigo.operators.ranking import top_k

NEAREST = [("distance", "ascending"), ("id", "ascending")]


def vectors(spark, rows, schema="id bigint, vector array<double>"):
    return spark.createDataFrame(rows, schema)


def plain(a, b, metric):
    if metric == "l2":
        return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
    if metric == "l1":
        return sum(abs(x - y) for x, y in zip(a, b))
    dot, aa, bb = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a), sum(y * y for y in b)
    if metric == "cosine":
        return 1 - dot / math.sqrt(aa * bb) if aa * bb else None
    if metric == "tanimoto":
        return 1 - dot / (aa + bb - dot) if aa + bb - dot else None
    return sum((x - y) ** 2 / (x + y) for x, y in zip(a, b) if x + y)


@pytest.fixture(scope="module")
def items():
    random.seed(3)
    rows = [(i, [float(random.randint(0, 3)) for _ in range(6)]) for i in range(90)]
    return rows + [(500 + i, rows[4][1]) for i in range(20)]


def brute(items, queries, k, metric):
    out = []
    for qid, q in queries:
        ranked = sorted((round(d, 6), i) for i, v in items if (d := plain(q, v, metric)) is not None)[:k]
        out += [(qid, i, pytest.approx(d, abs=1e-6), n + 1) for n, (d, i) in enumerate(ranked)]
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize("metric", METRICS)
def test_distance_expression(spark, items, metric):
    got = feature_distance(vectors(spark, items), vectors(spark, items[3:4]), metric).collect()
    for r in got:
        assert r["distance"] == pytest.approx(plain(dict(items)[r["id"]], items[3][1], metric))


@pytest.mark.parametrize("metric", METRICS)
def test_nearest_every_way(spark, items, metric):
    queries = items[:12]
    want = brute(items, queries, 7, metric)
    q = vectors(spark, queries, "query_id bigint, vector array<double>")
    for ship in ({}, {"hold_rows": 14, "block_bytes": 1500, "ship_bytes": 5000}, {"ship_bytes": 2000, "block_bytes": 1500}, {"ship_bytes": 500, "block_bytes": 1500}):
        got = nearest(vectors(spark, items).repartition(5), q, 7, metric, digits=6, **ship)
        assert sorted(map(tuple, got.collect())) == want


def test_nearest_ships_the_smaller_side(spark, items):
    few = items[:10]
    q = vectors(spark, items, "query_id bigint, vector array<double>")
    got = nearest(vectors(spark, few), q, 3, ship_bytes=1000, digits=6)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == brute(few, items, 3, "l2")


def test_nearest_with_large_norms_is_exact(spark):
    rng = np.random.default_rng(1)
    base = 1e6 + rng.random(16)
    rows = [(i, [float(x) for x in base + rng.random(16) * 1e-3]) for i in range(300)]
    q = vectors(spark, [(0, rows[0][1])], "query_id bigint, vector array<double>")
    got = [r["id"] for r in nearest(vectors(spark, rows), q, 20).orderBy("rank").collect()]
    want = sorted(rows, key=lambda r: (plain(r[1], rows[0][1], "l2"), r[0]))[:20]
    assert got == [i for i, _ in want]


def test_missing_and_broken_vectors(spark):
    corpus = vectors(spark, [(1, None), (2, [1.0, float("nan")]), (3, [0.0, 0.0]), (4, [3.0, 4.0])])
    query = vectors(spark, [(9, [0.0, 0.0])])
    got = {r["id"]: r["distance"] for r in feature_distance(corpus, query).collect()}
    assert got[1] is None and math.isnan(got[2]) and got[3] == 0 and got[4] == 5
    marked = {r["id"]: r["distance"] for r in feature_distance(corpus, query, missing="sentinel").collect()}
    assert marked[1] == -1
    near = nearest(corpus, query.withColumnRenamed("id", "query_id"), 10)
    assert [(r["id"], r["distance"]) for r in near.orderBy("rank").collect()] == [(3, 0.0), (4, 5.0)]
    assert nearest(corpus, query.withColumnRenamed("id", "query_id"), 10, "cosine").count() == 0
    cosine = {r["id"]: r["distance"] for r in feature_distance(corpus, query, "cosine").collect()}
    assert cosine[3] is None


def test_unequal_lengths_and_wrong_columns_raise(spark):
    corpus, query = vectors(spark, [(1, [1.0, 2.0])]), vectors(spark, [(1, [1.0])])
    with pytest.raises(Exception, match="unequal length"):
        feature_distance(corpus, query).collect()
    with pytest.raises(Exception, match="unequal length"):
        nearest(corpus, query.withColumnRenamed("id", "query_id"), 1).collect()
    with pytest.raises(ValueError):
        feature_distance(spark.createDataFrame([(1, "x")], "id int, vector string"), query)
    with pytest.raises(ValueError):
        nearest(corpus, query.withColumnRenamed("id", "query_id"), 1, "hamming")
    with pytest.raises(ValueError):
        distance("a", "b", "hamming")


def test_feature_table_keeps_failures_apart(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "xyz")], "id bigint, text string")

    def lengths(frame: pd.DataFrame) -> pd.Series:
        return frame["text"].map(lambda t: [float(len(t)), 1.0])

    table = features.build_feature_table(df, "id", {
        "size": F.array(F.length("text")), "python": lengths})
    good = {(r["id"], r["kind"]): r["vector"] for r in features.good_features(table).collect()}
    assert good[1, "python"] == [2.0, 1.0] and good[3, "size"] == [3.0]
    bad = features.failed_features(table, "id").collect()
    assert [(r["id"], r["kind"]) for r in bad] == [(2, "python")] and "TypeError" in bad[0]["error"]
    assert features.repeated_ids(table, "id").count() == 0
    assert features.repeated_ids(table.union(table), "id").count() == 6


def test_cut_and_join_vectors(spark):
    df = vectors(spark, [(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [])])
    local = features.cut_vectors(df, 2)
    assert [(r["pos"], r["vector"]) for r in local.orderBy("pos").collect()] == [(0, [1, 2]), (1, [3, 4]), (2, [5])]
    assert features.join_vectors(local).first()["vector"] == [1, 2, 3, 4, 5]


def test_words_of_a_large_and_a_small_codebook_agree(spark, items):
    local = vectors(spark, [(i, 0, v) for i, v in items], "id bigint, pos int, vector array<double>")
    book = vectors(spark, [(w, v) for w, (_, v) in enumerate(items[:30])] + [(77, items[0][1])],
                   "word int, vector array<double>")
    small = features.assign_words(local, book, digits=6)
    large = features.assign_words(local, book, digits=6, ship_bytes=400)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    for r in small.collect():
        best = min((round(plain(dict(items)[r["id"]], v, "l2"), 6), w) for w, (_, v) in enumerate(items[:30]))
        assert (r["word"], r["distance"]) == (best[1], pytest.approx(best[0], abs=1e-6))


def test_histograms(spark):
    words = spark.createDataFrame([(1, p, w) for p, w in enumerate([0, 2, 2, 3])], "id bigint, pos int, word int")
    hist = features.word_histogram(words)
    dense = features.dense_histogram(hist, 5)
    assert dense.first()["vector"] == [1, 0, 2, 1, 0]
    assert sorted(map(tuple, features.histogram_terms(hist).collect())) == [("v2", 1, 2), ("v3", 1, 1)]
    assert features.histogram_terms(hist, first_bin=0).count() == 3
    assert dense.select(histogram_string("vector")).first()[0] == "v2 v2 v3"
    assert dense.select(histogram_string("vector", 0)).first()[0] == "v0 v2 v2 v3"
    odd = vectors(spark, [(1, [9.9, 2.9, 0.9, 0.0]), (2, [4.0, 0.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0, 0.0])])
    assert [r[0] for r in odd.orderBy("id").select(histogram_string("vector")).collect()] == ["v1 v1", "", ""]
    assert sorted(map(tuple, features.sparse_histogram(odd).collect())) == [(1, 0, 9), (1, 1, 2), (2, 0, 4)]


def test_search_by_histogram_equals_search_by_its_string(spark, items):
    dense = vectors(spark, items)
    postings = features.histogram_terms(features.sparse_histogram(dense)).withColumnRenamed("id", "doc_id")
    texts = dense.select(F.col("id").alias("doc_id"), histogram_string("vector").alias("text"))
    q = texts.filter("doc_id = 5").withColumnRenamed("doc_id", "query_id")
    a = search.search_postings(postings, search.query_terms(q))
    b = search.search_texts(texts, q)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def two_kinds(spark, items):
    return features.feature_lists({
        "a": vectors(spark, items), "b": vectors(spark, [(i, v[::-1]) for i, v in items])})


def test_fusion_properties(spark, items):
    table = two_kinds(spark, items)
    query = table.filter("id = 3").withColumnRenamed("id", "query_id")
    single = feature_distance(vectors(spark, items), vectors(spark, [items[3]]), digits=6)
    ranking = [r["id"] for r in top_k(single, 10, NEAREST).orderBy("rank").collect()]

    def run(kinds, weights, **kw):
        return [r["id"] for r in fusion.fused_query(table, query, kinds, weights, 10, digits=6, **kw).orderBy("rank").collect()]

    assert run(["a", "a"], fusion.pair_weights(0.5)) == ranking
    assert run(["a", "b"], [1.0, 0.0]) == ranking
    batch = fusion.fused_batch(table, query, ["a", "b"], [0.5, 0.5], 15, 10, digits=6)
    alone = fusion.fused_query(table, query, ["a", "b"], [0.5, 0.5], 10, top_n=15, digits=6)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, alone.collect()))
    with pytest.raises(ValueError):
        fusion.fused_query(table, query, ["a"], [0.5, 0.5])


def test_one_pipeline_serves_collection_and_query(spark, items):
    double = features.pipeline(lambda df: df.withColumn("vector", F.transform("vector", lambda x: x * 2)),
                               lambda df: df.withColumn("vector", F.reverse("vector")))
    steps = {"plain": features.pipeline(), "double": double}
    table = fusion.projected_kinds(vectors(spark, items), steps)
    query = fusion.projected_kinds(vectors(spark, [items[3]], "query_id bigint, vector array<double>"), steps)
    best = fusion.fused_query(table, query, list(steps), [0.5, 0.5], 1)
    assert best.first()["id"] == 3 and best.first()["score"] == pytest.approx(1)


def test_fuse_counts_absent_as_zero(spark):
    a = spark.createDataFrame([(1, 10, 1.0), (1, 11, 0.5)], "query_id int, id int, score double")
    b = spark.createDataFrame([(1, 11, 1.0), (1, 12, float("nan"))], "query_id int, id int, score double")
    got = {r["id"]: r["score"] for r in fusion.fuse([a, b], [0.6, 0.4]).collect()}
    assert got == pytest.approx({10: 0.6, 11: 0.7})
    assert fusion.fuse([a.limit(0), b.limit(0)], [1, 1]).count() == 0


def test_cascade_of_whole_sizes_is_the_last_ranking(spark, items):
    table = vectors(spark, items).withColumn("other", F.reverse("vector"))
    query = table.filter("id = 3")
    n = len(items)
    got = fusion.cascade(table, query, [fusion.Stage("other", "l1", n), fusion.Stage("vector", "l2", n)], digits=6)
    want = top_k(feature_distance(table, query, "l2", digits=6), n, NEAREST)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    short = fusion.cascade(table, query, [fusion.Stage("other", "l1", 20), fusion.Stage("vector", "l2", 5)], digits=6)
    first = sorted(items, key=lambda r: (round(plain(r[1][::-1], items[3][1][::-1], "l1"), 6), r[0]))[:20]
    last = sorted(first, key=lambda r: (round(plain(r[1], items[3][1], "l2"), 6), r[0]))[:5]
    assert [r["id"] for r in short.orderBy("rank").collect()] == [i for i, _ in last]


def test_codebook_training_assigns_the_nearest_centre(spark, items):
    local = vectors(spark, [(i, 0, v) for i, v in items], "id bigint, pos int, vector array<double>")
    model = models.train_codebook(local, 4, seed=1)
    book = models.codebook_table(model, spark)
    assert book.count() == 4
    by_model = {r["id"]: r["word"] for r in models.model_words(model, local).collect()}
    centres = {r["word"]: r["vector"] for r in book.collect()}
    for i, v in items:
        near = min(plain(v, c, "l2") for c in centres.values())
        assert plain(v, centres[by_model[i]], "l2") == pytest.approx(near)


@pytest.mark.parametrize("limit, terms", [(models.MAX_VOCABULARY, "named"), (8, "hashed")])
def test_topics_sum_to_one(spark, limit, terms):
    texts = [(i, " ".join(random.Random(i).choices(["ball", "goal", "team"] if i % 2 else ["star", "moon", "sky"], k=20))
              + f" w{i}") for i in range(30)]
    docs = spark.createDataFrame(texts + [(99, "")], "doc_id bigint, text string")
    model = models.train_topics(docs, 3, max_iter=5, max_vocabulary=limit, terms=terms)
    shares = {r["id"]: r["vector"] for r in models.topic_transform(model, docs, "doc_id").withColumnRenamed("doc_id", "id").collect()}
    assert len(shares) == 31
    assert all(len(v) == 3 and sum(v) == pytest.approx(1) for v in shares.values())


def test_topics_recover_the_words_they_were_drawn_from(spark):
    fields = [[f"{name}{i}" for i in range(12)] for name in ("sea", "sky")]
    draw = random.Random(4)
    texts = [(i, " ".join(draw.choices(fields[i % 2], k=40))) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    model = models.train_topics(docs, 2, max_iter=100)
    main = {r["doc_id"]: int(np.argmax(r["vector"])) for r in models.topic_transform(model, docs).collect()}
    assert {main[i] for i in range(0, 80, 2)} != {main[i] for i in range(1, 80, 2)} and len(set(main.values())) == 2
    words = model.stages[0].vocabulary
    for topic in model.stages[1].describeTopics(12).collect():
        best = {words[i] for i in topic["termIndices"]}
        assert best in ({*fields[0]}, {*fields[1]}) and sum(topic["termWeights"]) > 0.9


def test_vocabulary_is_cut_by_document_frequency(spark):
    docs = spark.createDataFrame([("a a b c",), ("a b d",), ("a b c",), (None,), ("",), ("a e",)], "text string")
    found = lambda most: {r["term"]: r["df"] for r in models.vocabulary(docs, most).collect()}
    assert found(9) == found(5) == {"a": 4, "b": 3, "c": 2, "d": 1, "e": 1}
    assert found(4) == found(3) == {"a": 4, "b": 3, "c": 2}
    assert found(1) == {"a": 4} and set(models.vocabulary(docs, 3, stop_words=["a"]).toPandas()["term"]) == {"b", "c"}
    assert models.train_topics(docs, 2, max_iter=1, max_vocabulary=4).stages[0].vocabulary == ["a", "b", "c"]
    with pytest.raises(ValueError):
        models.vocabulary(spark.createDataFrame([("a b",), ("a b",)], "text string"), 1)
    assert models.vocabulary(docs.limit(0), 1).count() == 0


def test_correlation_equals_numpy(spark):
    rng = np.random.default_rng(2)
    hidden = rng.normal(size=(200, 2))
    text = np.hstack([hidden, rng.normal(size=(200, 2))]) @ rng.normal(size=(4, 4))
    image = np.hstack([hidden + 0.1 * rng.normal(size=(200, 2)), rng.normal(size=(200, 3))]) @ rng.normal(size=(5, 5))
    rows = [(i, [float(x) for x in text[i]], [float(x) for x in image[i]]) for i in range(200)]
    t = vectors(spark, [(i, a) for i, a, _ in rows])
    m = vectors(spark, [(i, b) for i, _, b in rows])
    pairs = crossmodal.pair_views(t, m, spark.createDataFrame([(i, i) for i in range(200)], "text_id bigint, image_id bigint"))
    for parts in (1, 9):
        model = crossmodal.fit_correlation(pairs.repartition(parts), reg=1e-9)
        rho = model.correlations
        assert np.all(np.diff(rho) <= 1e-9) and np.all((rho >= 0) & (rho <= 1))
        qa, _ = np.linalg.qr(text - text.mean(0))
        qb, _ = np.linalg.qr(image - image.mean(0))
        np.testing.assert_allclose(rho, np.linalg.svd(qa.T @ qb)[1], atol=1e-5)
    assert rho[1] > 0.9
    again = crossmodal.read_correlation(crossmodal.correlation_table(model, spark))
    np.testing.assert_array_equal(again.image_weights, model.image_weights)
    best = crossmodal.fit_correlation(pairs, components=2)
    asking = m.withColumnRenamed("id", "query_id")
    names = t.select("id", F.lit("c").alias("category"))
    found = crossmodal.text_for_images(best, t, asking, names, 5)
    assert found.columns == ["query_id", "id", "category", "score", "rank"] and found.count() == 1000
    hits = found.filter("query_id = id").count()
    assert hits > 60
    back = crossmodal.images_for_texts(best, m, t.withColumnRenamed("id", "query_id"), k=5)
    assert back.filter("query_id = id").count() > 60


def wide_pairs(spark, n=160, p=2048, q=2048, noise=0.0):
    rng = np.random.default_rng(3)
    hidden = rng.normal(size=(n, 6))
    text = np.hstack([hidden, rng.normal(size=(n, 14))]) @ rng.normal(size=(20, p)) + 5 + noise * rng.normal(size=(n, p))
    image = np.hstack([hidden * [9, 5, 3, 2, 1, .5] + rng.normal(size=(n, 6)), rng.normal(size=(n, 10))]) @ rng.normal(size=(16, q)) + noise * rng.normal(size=(n, q))
    flat = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
    return text, image, spark.createDataFrame(pa.table({"text_vector": flat(text), "image_vector": flat(image)})).repartition(4)


def test_wide_correlation_equals_the_dense_solver(spark):
    text, image, pairs = wide_pairs(spark)
    model = crossmodal.fit_correlation(pairs, components=6, rank=32)
    a, b = text - text.mean(0), image - image.mean(0)
    n = len(a) - 1
    wt, wi, rho = crossmodal.solve_correlation(a.T @ a / n, b.T @ b / n, a.T @ b / n, 1e-3)
    np.testing.assert_allclose(model.correlations, rho[:6], atol=1e-6)
    np.testing.assert_allclose(model.text_weights, wt[:, :6], atol=1e-6)
    np.testing.assert_allclose(model.image_weights, wi[:, :6], atol=1e-6)
    np.testing.assert_allclose(model.text_mean, text.mean(0), atol=1e-9)


def test_wide_correlation_grows_its_rank_or_raises(spark):
    text, image, pairs = wide_pairs(spark, 60, 40, 30, 0.01)
    model = crossmodal.fit_correlation(pairs, components=4, max_view=50, rank=4)
    dense = crossmodal.fit_correlation(pairs, components=4)
    np.testing.assert_allclose(model.correlations, dense.correlations, atol=0.02)
    with pytest.raises(ValueError, match="of the views' variance"):
        crossmodal.fit_correlation(pairs, max_view=16, rank=4)


@pytest.mark.parametrize("partitions, shuffle", [(1, "1"), (7, "300"), (40, "8")])
def test_moments_by_levels(spark, partitions, shuffle):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5)) + 1e6
    rows = [([float(v) for v in r[:2]], [float(v) for v in r[2:]]) for r in x]
    pairs = spark.createDataFrame(rows, "text_vector array<double>, image_vector array<double>").repartition(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        state = moments.product_state(pairs)
        (n, p), mean, cells = moments.state_of(state)
        got = {(r["i"], r["j"]): r["total"] for r in moments.product_cells(state).collect()}
        assert moments.state_of(moments.product_state(pairs.limit(0))) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (n, p) == (90, 2)
    np.testing.assert_allclose(mean, x.mean(0))
    want = (x - x.mean(0)).T @ (x - x.mean(0))
    np.testing.assert_allclose(cells, want[np.triu_indices(5)], atol=1e-6)
    assert len(got) == 15 and got[1, 3] == pytest.approx(want[1, 3], abs=1e-6)


def test_correlation_of_dependent_columns_stays_finite(spark):
    shares = np.random.default_rng(0).dirichlet(np.ones(4), 60)
    t = vectors(spark, [(i, [float(x) for x in s]) for i, s in enumerate(shares)])
    pairs = crossmodal.pair_views(t, t, t.select(F.col("id").alias("text_id"), F.col("id").alias("image_id")))
    model = crossmodal.fit_correlation(pairs)
    assert np.all(np.isfinite(model.text_weights)) and model.correlations[0] > 0.9
    with pytest.raises(ValueError):
        crossmodal.fit_correlation(pairs.limit(0))


def test_codebook_edges(spark):
    none = vectors(spark, [], "word int, vector array<double>")
    local = vectors(spark, [(1, 0, [1.0, 2.0]), (2, 0, None), (3, 0, [5.0, 5.0])], "id bigint, pos int, vector array<double>")
    assert features.assign_words(local, none).count() == 0
    model = models.train_codebook(local, 2, seed=1)
    assert {r["id"] for r in models.model_words(model, local).collect()} == {1, 3}
    hist = vectors(spark, [(1, 0, 2), (1, 9, 5)], "id bigint, word int, n bigint")
    with pytest.raises(Exception, match="a word outside 0 to 4"):
        features.dense_histogram(hist, 5).collect()
    items = spark.range(1, 3)
    dense = {r["id"]: r["vector"] for r in features.dense_histogram(hist.filter("word < 5"), 3, items=items).collect()}
    assert dense == {1: [2.0, 0.0, 0.0], 2: [0.0, 0.0, 0.0]}


def test_l2_of_huge_entries(spark):
    corpus = vectors(spark, [(1, [1e200, 0.0]), (2, [3e200, 4e200]), (3, [0.0, 1.0])], "id bigint, vector array<double>")
    query = vectors(spark, [(7, [0.0, 0.0])], "query_id bigint, vector array<double>")
    want = [(3, 1.0), (1, 1e200), (2, 5e200)]
    near = nearest(corpus, query, 5).orderBy("rank").collect()
    assert [(r["id"], pytest.approx(r["distance"])) for r in near] == want
    far = feature_distance(corpus, query).orderBy("distance").collect()
    assert [(r["id"], pytest.approx(r["distance"])) for r in far] == want


def test_fusion_combiner_and_exact_batch(spark):
    rng = random.Random(4)
    rows = [(i, kind, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(40) for kind in ("a", "b") if i % 7 or kind == "a"]
    table = vectors(spark, rows, "id bigint, kind string, vector array<double>")
    asked = table.filter("id in (3, 7)").withColumnRenamed("id", "query_id")
    got = sorted(map(tuple, fusion.fused_batch(table, asked, ["a", "b"], [0.3, 0.7], k=12, digits=6).collect()))
    want = []
    for q in (3, 7):
        one = fusion.fused_query(table, asked.filter(f"query_id = {q}"), ["a", "b"], [0.3, 0.7], 12, digits=6) if q == 3 else None
        want += map(tuple, one.collect()) if one is not None else []
    assert [r for r in got if r[0] == 3] == sorted(want)
    lists = [vectors(spark, [(1, 5, 0.2)], "query_id int, id int, score double"), vectors(spark, [(1, 5, 0.6)], "query_id int, id int, score double")]
    assert fusion.fuse(lists, [1, 1], combine=F.max).first()["score"] == 0.6
