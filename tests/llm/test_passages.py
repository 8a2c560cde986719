"""Repeated passages: planted inside lines, against plain Python, on odd rows."""

import random

import duckdb
import pytest

from vestigo.llm import passages


def words(draw, n, stop=9):
    return " ".join(f"w{draw.randrange(10 ** 6)}" + ("." if draw.randrange(stop) == 0 else "") for _ in range(n))


def plain_spans(rows, by, least_words, least_unit):
    """Spans of documents in order of id, each unit looked up in a dictionary."""
    first, found = {}, []
    for doc, text in sorted(((d, t) for d, t in rows if t is not None)):
        run = None
        k = 0
        for begin, stop, unit in passages.units_of(text, by):
            if len(unit) < least_unit:
                continue
            key = tuple(unit)
            if first.setdefault(key, (doc, k)) != (doc, k):
                run = run or [doc, begin, stop, 0, 0, first[key][0]]
                run[2], run[3], run[4] = stop, run[3] + 1, run[4] + len(unit)
            elif run:
                found.append(tuple(run))
                run = None
            k += 1
        if run:
            found.append(tuple(run))
    return sorted(s for s in found if s[4] >= least_words)


@pytest.mark.parametrize("by, least_words, least_unit", [("sentence", 30, 3), ("line", 5, 1), ("paragraph", 1, 1), ("sentence", 1, 1)])
def test_plain(spark, by, least_words, least_unit):
    draw = random.Random(6)
    pool = ["One line.", "two  WORDS\there.", words(draw, 30, 40), words(draw, 40), "é ü. Ö!", "", " \t"]
    rows = [(i, draw.choice(["\n", "\n\n", " ", "\n \n"]).join(draw.choices(pool, k=draw.randrange(6)))) for i in range(40)] + [(99, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = passages.repeated_spans(frame, least_words, by, least_unit).drop("row").collect()
    assert sorted(map(tuple, got)) == plain_spans(rows, by, least_words, least_unit)


def test_units_are_cut_at_content():
    draw = random.Random(1)
    for _ in range(200):
        text = words(draw, draw.randrange(60), draw.choice([3, 10 ** 9])) + draw.choice(["", "\n", " \r", "?! x", ".x. y"])
        parts = list(passages.units_of(text))
        assert [w for _, _, unit in parts for w in unit] == text.encode().lower().split()
        assert all(text[a:b].encode().lower().split() == unit and text[a:b] == text[a:b].strip() for a, b, unit in parts)


def test_planted_passages_inside_lines(spark, tmp_path):
    from vestigo.llm import queries
    draw = random.Random(3)
    shared, plain = words(draw, 80), words(draw, 90, 10 ** 9)
    rows = [(i, f"{words(draw, 20, 99)} {shared} {words(draw, 30, 99)}\n{words(draw, 40)}") for i in range(5)]
    rows += [(10 + i, f"{words(draw, 33, 99)} {plain} {words(draw, 25, 99)}") for i in range(5)]
    rows += [(20 + i, words(draw, 200)) for i in range(30)] + [(60, "many words " * 300_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, passages.repeated_spans(frame).drop("row").collect()))
    assert {r[0] for r in got if r[0] < 60} == {1, 2, 3, 4, 11, 12, 13, 14} and all(r[5] < r[0] or r[0] == 60 for r in got)
    frame.filter("doc_id < 60").write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert sorted(con.execute(queries.SQL["op8_passages"]).fetchall()) == [r for r in got if r[0] < 60]


def test_spans_are_cut_out_of_their_own_row(spark):
    line = "these three words and more stand in two rows"
    rows = [(1, line, 5, "a"), (3, f"own first line\n{line}\nlast line of it", 6, "b"), (3, f"{line}. Another text altogether here", 7, "c"),
            (3, f"{line}. Another text altogether here", 7, "c"), (None, f"Begin of it.\n{line}", 8, "d"), (4, None, 9, "e"), (5, "", 9, "e")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, row int, `cuts of` string")
    left = passages.without_spans(frame, passages.repeated_spans(frame, 5))
    assert left.columns == frame.columns
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, [
        (1, line, 5, "a"), (3, "own first line\n\nlast line of it", 6, "b"), (3, f"{line}. Another text altogether here", 7, "c"),
        (3, f"{line}. Another text altogether here", 7, "c"), (None, "Begin of it.\n", 8, "d"), (4, None, 9, "e"), (5, "", 9, "e")]))
    assert passages.repeated_spans(frame.limit(0)).collect() == []
