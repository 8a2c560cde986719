"""The index in segments against an index built anew."""

import os
import random
import re

import pytest

from vestigo.operators import search
from vestigo.sources import segments, tables

SCHEMA = "doc_id bigint, text string"
WORDS = [f"w{i}" for i in range(30)] + ["the"] * 10


def sample(draw, ids):
    return {i: " ".join(draw.choice(WORDS) for _ in range(draw.randrange(0, 12))) for i in ids}


def agrees(spark, index, docs, tmp_path):
    """Postings, terms, documents and searches equal those of an index built from ``docs`` alone."""
    frame = spark.createDataFrame(list(docs.items()), SCHEMA)
    built = tables.save_index(frame, str(tmp_path / f"built-{random.random()}"), buckets=4)
    for name, key in (("postings", ("term", "doc_id", "tf")), ("terms", ("term", "df", "idf")), ("docs", ("doc_id", "length", "norm"))):
        got, want = (sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in getattr(i, name).select(*key).collect())
                     for i in (index, built))
        assert got == want, name
    query = search.query_terms(spark.createDataFrame([(1, "the w1 w2 w2"), (2, "w7")], "query_id bigint, text string"))
    cut = tables.only_terms(index, query)
    assert sorted(map(tuple, search.search_postings(cut.postings, query).collect())) == sorted(
        map(tuple, search.search_postings(built.postings, query).collect()))
    assert sorted(map(tuple, search.search_weighted(cut, query).collect())) == sorted(map(tuple, search.search_weighted(built, query).collect()))


def postings_files(path):
    return {f for top, _, files in os.walk(path) if "/postings" in top for f in files if f.endswith(".parquet")}


def test_refreshes_and_compaction(spark, tmp_path):
    draw, path = random.Random(4), str(tmp_path / "index")
    docs = sample(draw, range(60))
    segments.create(spark.createDataFrame([*docs.items(), (None, "no id")], SCHEMA), path, buckets=4)
    for round in range(3):
        gone = draw.sample(sorted(docs), 5)
        changed = draw.sample(sorted(set(docs) - set(gone)), 4)
        fresh = [100 + round, *gone[:1]] if round else [100]
        before = postings_files(path)
        for i in gone:
            del docs[i]
        docs |= sample(draw, changed + fresh)
        index = segments.refresh(spark.createDataFrame(list(docs.items()), SCHEMA), path, buckets=4)
        assert before < postings_files(path)
        written = spark.read.parquet(*[f"{path}/{d}/postings" for d in os.listdir(path) if d == segments._log(spark, path)[2][-1].name])
        assert {r["doc_id"] for r in written.select("doc_id").distinct().collect()} <= {*changed, *fresh}
    before = postings_files(path)
    again = segments.refresh(spark.createDataFrame(list(docs.items()), SCHEMA), path)
    assert postings_files(path) == before
    assert len(segments._log(spark, path)[2]) == 4
    want = sorted(map(tuple, again.docs.collect()))
    assert sorted(map(tuple, segments.save_norms(spark, path).docs.collect())) == want
    assert all("/norms-" in f for f in segments.load(spark, path).docs.inputFiles())
    segments.compact(spark, path, 2)
    assert len(segments._log(spark, path)[2]) == 3
    docs[0] = "the last the"
    segments.refresh(spark.createDataFrame(list(docs.items()), SCHEMA), path)
    agrees(spark, segments.load(spark, path), docs, tmp_path)
    agrees(spark, segments.compact(spark, path, 0), docs, tmp_path)
    only, = segments._log(spark, path)[2]
    assert (only.n_docs, only.n_gone) == (len(docs), 0)


def test_search_reads_only_wanted_buckets(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = sample(random.Random(1), range(40))
    segments.create(spark.createDataFrame(list(docs.items()), SCHEMA), path, buckets=8)
    index = segments.refresh(spark.createDataFrame([*docs.items(), (99, "w1 new")], SCHEMA), path)
    query = search.query_terms(spark.createDataFrame([(1, "w1")], "query_id bigint, text string"))
    plan = tables.only_terms(index, query).terms._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*bucket", plan)) >= 2


def test_which_segments_are_merged():
    seg = lambda n: segments.Segment("x", 1, n, 0)
    assert segments.tiers([seg(5)] * 8) == 8
    assert segments.tiers([seg(1000)] + [seg(5)] * 8) == 1
    assert segments.tiers([seg(10 ** 6), seg(10 ** 4)] + [seg(10)] * 8) == 2
    assert segments.tiers([seg(10 ** i) for i in range(10, 0, -1)]) == 7


def test_odd_uses(spark, tmp_path):
    with pytest.raises(ValueError):
        segments.load(spark, str(tmp_path / "nothing"))
    path = str(tmp_path / "index")
    segments.create(spark.createDataFrame([], SCHEMA), path, buckets=2)
    assert segments.load(spark, path).postings.count() == 0
    index = segments.refresh(spark.createDataFrame([(1, None), (2, ""), (3, "a a")], SCHEMA), path)
    assert sorted(map(tuple, index.docs.collect())) == [(1, 0, 0.0), (2, 0, 0.0), (3, 2, pytest.approx(2 ** .5 * 1.0986122886681098))]
    with pytest.raises(ValueError):
        segments.refresh(spark.createDataFrame([], SCHEMA), path, buckets=3)
    assert segments.refresh(spark.createDataFrame([], SCHEMA), path).docs.count() == 0
