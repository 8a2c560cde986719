import os

import pytest
from pyspark.sql import functions as F

from vestigo.operators import models, refresh, search
from vestigo.sources import readers, tables

XML = """<?xml version="1.0" encoding="UTF-8"?>
<document id="{id}" name="{name}" cat="7">
<text>
First line of {name}.

Second &amp; last.
</text>
<imageset>{images}</imageset>
</document>
"""
IMAGE = '<image id="{0}" name="n{0}" sectnum="3#1">../img/{0}.jpg</image>'


@pytest.fixture
def documents(tmp_path):
    folder = tmp_path / "docs" / "deep"
    folder.mkdir(parents=True)
    (tmp_path / "docs" / "one.xml").write_text(XML.format(id="d-1", name="One", images=IMAGE.format("i1")))
    (folder / "two.xml").write_text(XML.format(id="d-2", name="Two", images=IMAGE.format("i2") + IMAGE.format("i3")))
    (folder / "three.xml").write_text(XML.format(id="d-3", name="Three", images=""))
    (folder / "note.txt").write_text("no document")
    (folder / "p1.jpg").write_bytes(b"\xff\xd8one")
    (tmp_path / "docs" / "p2.jpg").write_bytes(b"\xff\xd8twotwo")
    return tmp_path / "docs"


def test_documents_of_a_folder_and_a_file(spark, documents):
    rows = {r["doc_id"]: r for r in readers.load(spark, str(documents), readers.TEXT).collect()}
    assert set(rows) == {"d-1", "d-2", "d-3"}
    assert rows["d-1"]["cat"] == 7 and "Second & last." in rows["d-1"]["text"]
    assert [i["id"] for i in rows["d-2"]["images"]] == ["i2", "i3"]
    assert rows["d-1"]["images"][0].asDict() == {"id": "i1", "name": "ni1", "sectnum": "3#1", "path": "../img/i1.jpg"}
    assert rows["d-3"]["images"] == []
    one = readers.read_documents(spark, str(documents / "one.xml")).collect()
    assert [r["doc_id"] for r in one] == ["d-1"] and one[0]["path"].endswith("one.xml")


def test_images_and_listing(spark, documents):
    images = readers.load(spark, str(documents), readers.IMAGE)
    assert {(r["id"], r["length"], bytes(r["content"])[2:]) for r in images.collect()} == {
        ("p1", 5, b"one"), ("p2", 8, b"twotwo")}
    assert readers.read_images(spark, str(documents / "p2.jpg")).count() == 1
    every = readers.list_objects(spark, str(documents))
    assert every.count() == 6 and every.columns == ["path", "length"]
    assert readers.list_objects(spark, str(documents), ".txt").count() == 1


def test_kinds(spark, documents):
    with pytest.raises(NotImplementedError):
        readers.load(spark, str(documents), readers.VIDEO)
    with pytest.raises(ValueError):
        readers.load(spark, str(documents), "SOUND")
    with pytest.raises(ValueError):
        readers.load(spark, "", readers.TEXT)


def test_features_in_three_layouts(spark, tmp_path):
    rows = [("a", [[1.0, 2.0], [3.0, 4.0]]), ("b", [[5.0, 6.0]])]
    want = [("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("b", 0, [5.0, 6.0])]
    nested = spark.createDataFrame(rows, "id string, descriptors array<array<double>>")
    nested.write.parquet(str(tmp_path / "nested"))
    nested.write.json(str(tmp_path / "json"))
    spark.createDataFrame(want, "id string, pos int, vector array<double>").write.parquet(str(tmp_path / "long"))
    for name, form in (("nested", "parquet"), ("json", "json"), ("long", "parquet")):
        got = readers.read_features(spark, str(tmp_path / name), form)
        assert sorted(map(tuple, got.collect())) == want
    named = tmp_path / "img-7.json"
    named.write_text('{"descriptors": [[9, 8]]}')
    got = readers.read_features(spark, str(named), "json").collect()
    assert [tuple(r) for r in got] == [("img-7", 0, [9.0, 8.0])]
    with pytest.raises(ValueError):
        readers.read_features(spark, str(tmp_path / "nested"), descriptors="nothing")


def test_catalogs(spark, tmp_path):
    (tmp_path / "stop").write_text("the\nwould\nwould\n\n and \n")
    assert {r["word"] for r in readers.read_stop_words(spark, str(tmp_path / "stop")).collect()} == {"the", "would", "and"}
    assert readers.read_stop_words(spark, str(tmp_path / "stop")).count() == 3
    (tmp_path / "desc").write_text('d1\tart\tHe said "so"\nd2\tsport\tgoal\n')
    assert [tuple(r) for r in readers.read_descriptions(spark, str(tmp_path / "desc")).orderBy("doc_id").collect()] == [
        ("d1", "art", 'He said "so"'), ("d2", "sport", "goal")]
    (tmp_path / "truth").write_text("t1\ti1\t6\nt2\ti2\t9\n")
    assert [tuple(r) for r in readers.read_ground_truth(spark, str(tmp_path / "truth")).orderBy("text_id").collect()] == [
        ("t1", "i1", 6), ("t2", "i2", 9)]
    (tmp_path / "cats").write_text("art\nbiology\nsport\n")
    assert sorted(map(tuple, readers.read_categories(spark, str(tmp_path / "cats")).collect())) == [
        (1, "art"), (2, "biology"), (3, "sport")]


def test_queries_from(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id bigint, text string")
    assert sorted(map(tuple, readers.queries_from(df, [1, 3], "doc_id").collect())) == [(1, "a"), (3, "c")]
    assert readers.queries_from(df, [1], "doc_id").columns == ["query_id", "text"]


def test_spread_only_touches_few_files(spark, tmp_path):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    df.repartition(9).write.parquet(str(tmp_path / "many"))
    one = readers.spread(spark.read.parquet(str(tmp_path / "one")), "doc_id")
    assert one.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and one.count() == 1000
    many = spark.read.parquet(str(tmp_path / "many"))
    assert readers.spread(many, "doc_id") is many


def test_save_and_load(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not tables.table_exists(spark, path)
    tables.save_table(spark.range(3), path)
    tables.save_table(spark.range(5), path, "keep")
    assert tables.load_table(spark, path).count() == 3 and tables.table_exists(spark, path)
    tables.save_table(spark.range(5), path)
    assert tables.load_table(spark, path).count() == 5
    with pytest.raises(ValueError):
        tables.save_table(spark.range(5), path, "append")


DOCS = [(1, "the rose the lily"), (2, "a rose"), (3, "the end"), (4, "lily"), (6, "")]


def test_saved_index_prunes_buckets_and_refresh_equals_rebuild(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    index = tables.save_index(docs, str(tmp_path / "v1"), buckets=8)
    queries = spark.createDataFrame([(7, "the lily")], "query_id bigint, text string")
    q = search.query_terms(queries)
    pruned = tables.only_terms(index, q).postings
    assert len(os.listdir(tmp_path / "v1" / "postings")) > 3
    assert "PartitionFilters: [bucket" in pruned._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, search.search_texts(docs, queries).collect()))
    assert sorted(map(tuple, search.search_postings(pruned, q).collect())) == want
    whole = search.search_weighted(index, q)
    saved = search.search_weighted(tables.only_terms(index, q), q)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, saved.collect()))

    now = spark.createDataFrame(
        [(1, "the rose the lily"), (2, "a tulip"), (4, "lily"), (5, "brand new"), (6, "")], "doc_id bigint, text string")
    again = tables.refresh_index(str(tmp_path / "v1"), now, str(tmp_path / "v2"), buckets=8)
    built = tables.save_index(now, str(tmp_path / "v3"), buckets=8)
    for name in ("postings", "terms", "docs"):
        a = getattr(again, name).select(*sorted(set(getattr(built, name).columns)))
        b = getattr(built, name).select(*a.columns)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "v2" / "changed")).collect()) == [2, 5]


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, text string")
    same = tables.fingerprint(df)
    assert same == tables.fingerprint(df.orderBy(F.desc("id")).repartition(3)) == tables.fingerprint(df.select("text", "id"))
    assert same != tables.fingerprint(df.distinct())
    assert same != tables.fingerprint(df.withColumn("id", F.col("id").cast("bigint")))
    assert same != tables.fingerprint(df.limit(0))


def test_reuse_only_on_equal_steps_parameters_and_inputs(spark, tmp_path):
    built = []

    def run(rows, **params):
        df = spark.createDataFrame(rows, "id int")

        def build(path):
            built.append(path)
            tables.save_table(df.withColumn("x", F.col("id") * params["factor"]), path)

        out = tables.reuse_or_build(spark, str(tmp_path), "times", "multiply", params, {"in": df}, build,
                                    lambda path: tables.load_table(spark, path))
        return sorted(r["x"] for r in out.collect())

    assert run([(1,), (2,)], factor=3) == [3, 6]
    assert run([(2,), (1,)], factor=3) == [3, 6] and len(built) == 1
    assert run([(1,), (2,)], factor=4) == [4, 8] and len(built) == 2
    assert run([(1,), (5,)], factor=3) == [3, 15] and len(built) == 3


def test_a_trained_model_is_reused(spark, tmp_path):
    local = spark.createDataFrame([(i, 0, [float(i % 3), 1.0]) for i in range(30)], "id bigint, pos int, vector array<double>")
    runs = []

    def build(path):
        runs.append(path)
        models.train_codebook(local, 3).write().overwrite().save(path)

    for _ in range(2):
        model = tables.reuse_or_build(spark, str(tmp_path), "book", "kmeans", {"k": 3}, {"local": local}, build,
                                      models.KMeansModel.load)
    assert len(runs) == 1 and len(model.clusterCenters()) == 3


class _Session:
    """The two things a working folder depends on."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})()
        self.conf = {"spark.checkpoint.dir": folder}


def test_working_folder():
    assert tables.working_folder(_Session("yarn", "s3a://b/work/")) == "s3a://b/work"
    own = tables.working_folder(_Session("local[2]"))
    assert os.path.isdir(own) and own == tables.working_folder(_Session("local[2]"))
    with pytest.raises(ValueError):
        tables.working_folder(_Session("yarn"))


def test_saved_index_describes_itself(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a,b c"), (2, "c d"), (3, None)], "doc_id bigint, text string")
    path = str(tmp_path / "index")
    tables.save_index(docs, path, buckets=8, stop_words=["d"])
    index = tables.load_index(spark, path)
    assert index.settings.buckets == 8 and index.settings.stop_words == ("d",)
    query = search.query_terms(spark.createDataFrame([(7, "c a,b")], "query_id bigint, text string"))
    best = search.search_postings(tables.only_terms(index, query).postings, query).collect()
    assert [(r["doc_id"], r["score"]) for r in best] == [(1, 2), (2, 1)]
    with pytest.raises(ValueError):
        tables.load_index(spark, path, buckets=256)
    with pytest.raises(ValueError):
        tables.only_terms(index, query, buckets=256)
    with pytest.raises(ValueError):
        tables.refresh_index(path, docs, str(tmp_path / "other"), pattern="[^a-z0-9]+")
    grown = docs.unionByName(spark.createDataFrame([(4, "e,f d")], docs.schema))
    again = tables.refresh_index(path, grown, str(tmp_path / "new"))
    assert {r["term"] for r in again.postings.collect()} == {"a,b", "c", "e,f"}
    assert not again.postings.filter("term = 'd'").count()


def test_null_text_is_neither_changed_nor_gone(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id bigint, text string")
    stored = refresh.content_hashes(docs)
    assert refresh.changed_docs(docs, stored).count() == refresh.gone_docs(docs, stored).count() == 0


def test_scopes_delete_what_they_made(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "working_folder", lambda _: str(tmp_path))
    with tables.scope(spark):
        outer = tables.written(spark.range(5), "outer")
        with tables.scope(spark):
            inner = tables.written(spark.range(7), "inner")
            assert inner.count() == 7 and len(os.listdir(tmp_path)) == 2
        assert len(os.listdir(tmp_path)) == 1 and outer.count() == 5
    assert os.listdir(tmp_path) == []
    assert tables.written(spark.range(3), "kept").count() == 3


@pytest.mark.parametrize("name", ["distance_chi2", "distance_tanimoto", "bovw_search"])
def test_shared_frames_are_computed_once(spark, name):
    from vestigo import plans
    with tables.scope(spark):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 1


def test_fingerprints_by_file(spark, tmp_path):
    path, store = str(tmp_path / "t"), str(tmp_path / "digests")
    rows = spark.range(100).selectExpr("id", "id % 3 as part", "cast(id as string) as name")
    rows.repartition(4).write.partitionBy("part").parquet(path)
    whole = spark.read.parquet(path)
    assert tables.saved_fingerprint(spark, path, store) == tables.fingerprint(whole)
    read = spark.read.parquet(store).count()
    for top, _, files in os.walk(path):  # unreadable data with the same names, lengths and times: only listed
        for f in (os.path.join(top, f) for f in files if f.endswith(".parquet")):
            old = os.stat(f)
            os.remove(os.path.join(top, f".{os.path.basename(f)}.crc"))
            with open(f, "r+b") as out:
                out.write(b"XXXXXXXXXX")
            os.utime(f, ns=(old.st_atime_ns, old.st_mtime_ns))
    assert tables.saved_fingerprint(spark, path, store) == tables.fingerprint(rows.withColumn("part", F.col("part").cast("int")))
    assert spark.read.parquet(store).count() == read
    two, one = str(tmp_path / "two"), str(tmp_path / "one")
    rows.repartition(5).write.parquet(two)
    first = tables.saved_fingerprint(spark, two, store)
    rows.limit(10).write.mode("append").parquet(two)
    spark.catalog.refreshByPath(two)
    assert first != tables.saved_fingerprint(spark, two, store) == tables.fingerprint(spark.read.parquet(two))
    spark.read.parquet(two).coalesce(1).write.parquet(one)
    key = lambda source: tables.reuse_key("s", {"k": 1}, {"in": source}, spark, store)
    assert key(one) == key(two) == key(spark.read.parquet(one))
    rows.limit(0).write.parquet(str(tmp_path / "none"))
    assert tables.saved_fingerprint(spark, str(tmp_path / "none"), store) == tables.fingerprint(rows.limit(0))
    built = []
    build = lambda to: (built.append(to), rows.write.parquet(to))
    for _ in range(2):
        found = tables.reuse_or_build(spark, str(tmp_path / "saved"), "x", "steps", {}, {"in": one}, build, spark.read.parquet)
        assert found.count() == 100
    assert len(built) == 1
