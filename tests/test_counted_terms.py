"""Terms counted where texts are read."""

from vestigo.operators import terms


def test_counted_terms_need_no_shuffle_when_ids_differ(spark):
    rows = [(1, "a b  A"), (2, None), (3, ""), (None, "b b"), (5, "é a")] + [(i, "x y x " * (i % 4)) for i in range(10, 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for frame, shuffled in ((docs, False), (docs.unionByName(docs.limit(5)), True)):
        got = terms.counted_terms(frame)
        assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == shuffled
        assert sorted(map(repr, got.collect())) == sorted(map(repr, terms.term_frequencies(frame).collect()))
    stopped = terms.counted_terms(docs, pattern="[^a-z]+", stop_words=["a"])
    assert sorted(map(repr, stopped.collect())) == sorted(map(repr, terms.term_frequencies(docs, pattern="[^a-z]+", stop_words=["a"]).collect()))
