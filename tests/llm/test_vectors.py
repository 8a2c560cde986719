"""Near-duplicate vectors against all pairs: several pivots, repeated and missing ids, odd vectors."""

import numpy as np
import pytest

from vestigo.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, v int, w string"


def plain(rows):
    """(vec_id, n_links, component_id, kept) by all pairs of rows."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if g else None for g, (_, v) in zip(good, rows)]
    links = {i: [j for j in range(len(rows)) if j != i and good[j] and good[i] and unit[i] @ unit[j] >= 0.95] for i in range(len(rows))}
    found, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            group, front = {i}, [i]
            while front:
                for j in links[front.pop()]:
                    if j not in group:
                        group.add(j)
                        front.append(j)
            least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(group, least)
        id = rows[i][0]
        found.append((id, len(links[i]), seen[i], id is not None and id == seen[i]))
    return sorted(found, key=repr)


def got(spark, rows, **parameters):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, vectors.near_vectors(frame, **parameters).collect()), key=repr)


@pytest.mark.parametrize("parameters", [{}, {"cell": 30, "pivots": 20, "block": 8}, {"cell": 10, "pivots": 3, "block": 5}])
def test_all_pairs(spark, parameters):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(25, 6))
    rows = [(i, [float(x) for x in centres[i % 25] + 0.25 * draw.normal(size=6)]) for i in range(260)]
    rows += [(i, rows[i][1]) for i in range(0, 40, 2)] + [(None, rows[3][1]), (None, rows[3][1]), (None, [9.0, -9.0, 9.0, -9.0, 9.0, -9.0])]
    rows += [(500, None), (501, []), (502, [0.0] * 6), (503, [float("nan")] + [1.0] * 5), (504, [None] + [1.0] * 5), (None, None), (505, [1e30] * 6)]
    assert got(spark, rows, **parameters) == plain(rows)


def test_links_through_a_row_without_an_id(spark):
    rows = [(1, [1.0, 0.0]), (None, [0.96, 0.28]), (3, [0.8432, 0.5376]), (1, [0.0, 1.0])]
    assert got(spark, rows) == plain(rows)
    assert len(got(spark, rows)) == 4


def test_odd_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (None, [])]) == [(1, 0, 1, True), (None, 0, None, False)]
    with pytest.raises(ValueError, match="vectors of 2 to 4"):
        got(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0])])
