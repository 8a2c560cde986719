"""Nulls, empty texts, repeated rows and columns with clashing names."""

import random

import duckdb
import pyarrow as pa

import corpus_pipeline
from vestigo.llm import bpe, exact_dedup, licences, line_dedup, mixing, passages, queries, simhash, token_counts
from pyspark.sql import functions as F

ROWS = [(1, "A b c d e", "s", 1, "x"), (2, "a B c d e", None, 2, "y"), (3, None, "s", None, None), (4, "", None, 4, "z"),
        (None, "a b c d e", "t", 5, "q"), (1, "A b c d e", "s", 1, "x")]


def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, source string, n bigint, digest string")


def test_odd_rows(spark):
    docs = frame(spark)
    found = simhash.simhash_components(docs).collect()
    assert sorted((r["doc_id"] or 0, r["component"]) for r in found) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3)]
    same = exact_dedup.exact_dedup(docs, F.col("doc_id") % 2 == 0).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in same) == [
        (0, 2, 4, False), (1, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True), (3, 4, 2, False), (4, 4, 2, True)]
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mix(docs).count() == 6
    assert bpe.encode_and_decode(docs, queries.vocabulary(queries.WORDS_FILE)).filter("size(ids) = 0").count() == 2
    counts = token_counts.prefix_counts(docs, queries.vocabulary(queries.PIECES_FILE))
    assert counts.filter(token_counts.total_tokens() == 0).count() == 2
    assert sorted(map(tuple, passages.repeated_spans(docs, 3).select("doc_id", "first_doc_id").collect()), key=repr) == [(2, 1), (None, 1)]
    assert licences.licence_scan(docs, licences.known_digests(spark)).count() == 0


def test_licence_forms():
    forms = [licences.canonical(t.lower().encode()) for t in (
        "Copyright (c) 2020 Someone\nLicenced under the MIT Licence!", "licensed  under THE\tmit-license", "© 2001 x\r\nlicensed under the mit license.")]
    assert set(forms) == {b"licensed under the mit license"}
    assert licences.canonical(b"non infringement v v percent") == b"noninfringement version version per cent"
    assert licences.canonical(b"the copyright holder, copyright holders") == b"the copyright owner copyright owners"
    assert licences.canonical("... café -- ...".encode()) == "café".encode() and licences.canonical(b"?! \n") == b""


def test_shared_keys_over_batches():
    draw = random.Random(5)
    for size in (1, 2, 3, 7, 500):
        rows = [(draw.randrange(40), draw.randrange(4) - 2 ** 63 * (draw.random() < 0.3)) for _ in range(120)] + [(3, 1)] * 4
        rows.sort()
        groups = {}
        for key, line in rows:
            groups.setdefault(key, set()).add(line)
        want = [(k, x) for k, found in sorted(groups.items()) if len(found) > 1 and min(found) < 0 for x in sorted(found)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at:at + size])], ["key", "line"])
                   for at in range(0, len(rows), size)] + [pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["key", "line"])]
        assert [tuple(r.values()) for b in line_dedup._shared_keys(batches) for r in b.to_pylist()] == want


def test_short_lines_repeat_by_exact_copies(spark):
    long = "these words make up one line of text"
    docs = spark.createDataFrame([(1, "Les.\nOn.\n \n" + long), (2, "les.\nan.\n" + long + "s"), (3, " LES. \nOn.\nnt onor. the of it.\n"),
                                  (4, "Nt  onor. The of it.\nnt onor. the of it")], "doc_id bigint, text string")
    found = {(r["doc_id"], r["line"]): (r["first_doc_id"], r["first_line"], r["kept"]) for r in line_dedup.line_classes(docs).collect()}
    assert found == {(1, 0): (1, 0, True), (1, 1): (1, 1, True), (1, 3): (1, 3, True), (2, 0): (1, 0, False), (2, 1): (2, 1, True),
                     (2, 2): (1, 3, False), (3, 0): (1, 0, False), (3, 1): (1, 1, False), (3, 2): (3, 2, True),
                     (4, 0): (3, 2, False), (4, 1): (4, 1, True)}
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert left == {1: "Les.\nOn.\n \n" + long, 2: "an.", 3: "nt onor. the of it.\n", 4: "nt onor. the of it"}


def test_full_licence_texts(spark, tmp_path):
    """Whole texts and file headers are known, in other case, with marks before each line; Spark and SQL agree on them."""
    names = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0")
    texts = [(n, t) for n, _, t in licences.KNOWN if len(t) > 600]
    assert {n for n, _ in texts} >= {*names, "MIT", "ISC"}
    rows = [(i, t) for i, (_, t) in enumerate(texts)] + [
        (100 + i, "\r\n".join(x if "opyright" in x else f"## {x.upper()}" for x in t.split("\n"))) for i, (_, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in licences.licence_scan(docs, licences.known_digests(spark)).collect())
    assert [(i, n) for i, unit, n, _ in got if unit == 0] == [(k + i, n) for k in (0, 100) for i, (n, _) in enumerate(texts)]
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert sorted(con.execute(queries.SQL["op10_licences"]).fetchall()) == got


def test_stages_keep_columns_of_any_names(spark):
    names = ("row", "ROW_", "gone", "gone_id", "_row", "_gone", "_gone_id", "side", "_side", "mix", "_mix", "copy", "_copy", "draw", "rate")
    text = "one line of some words\nand another line of words"
    rows = [(i, text + str(i % 3), "s", *range(i, i + len(names))) for i in range(12)] + [(None, None, None, *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    for stage in (corpus_pipeline.drop_lines, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        left = stage(spark, docs, "")
        assert left.columns == docs.columns
        found = left.collect()
        assert found and all(tuple(r)[3:] == (tuple(range(r["doc_id"], r["doc_id"] + len(names))) if r["doc_id"] is not None else
                                              tuple(range(len(names)))) for r in found)
        assert stage(spark, docs.limit(0), "").collect() == []


def test_copies_are_encoded_alike(spark):
    texts = ["a b c", "a b c", "d", "a b c", None, "", "d d", "d d"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    from tokenizers import Tokenizer
    reader = Tokenizer.from_file(queries.vocabulary(queries.WORDS_FILE))
    for r in bpe.encode_and_decode(docs, queries.vocabulary(queries.WORDS_FILE)).collect():
        want = reader.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == reader.decode(want, skip_special_tokens=False)


def test_stages_on_null_and_repeated_ids(spark):
    draw = random.Random(3)
    a, b, c, d, e = (" ".join(f"w{draw.randrange(10 ** 6)}" for _ in range(40)) for _ in range(5))
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (2, d), (2, a.upper()), (3, e), (3, e)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, [(1, a), (None, b), (None, c), (2, d), (3, e)]))
    lines = ["this line stands in several rows", "a second line of some other words", "and a third one that is unlike both"]
    rows = [(1, lines[0]), (2, lines[0] + "\nOwn."), (2, lines[1] + "\nElse."), (None, lines[1] + "\nLast of all."), (None, lines[2]), (None, lines[2]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = corpus_pipeline.drop_lines(spark, docs, "")
    assert left.columns == docs.columns
    want = [(1, lines[0]), (2, "Own."), (2, lines[1] + "\nElse."), (None, "Last of all."), (None, lines[2]), (None, ""), (None, None)]
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, want))
