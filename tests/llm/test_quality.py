"""The quality classifier against the same method in plain Python, over dictionaries; odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vestigo.llm import quality

M = (1 << 64) - 1
MIX = 0x9E3779B97F4A7C15


def plain_shape(word):
    if word.upper() == word.lower():
        case = 0
    elif word.islower():
        case = 1
    elif word.isupper():
        case = 3
    else:
        case = 2 if word.istitle() else 4
    marks = "".join(c for c in word if not c.isalnum())
    return case * 512 + (zlib.crc32(marks.encode()) % 511 + 1 if marks else 0)


def plain_kinds(text):
    """The two kinds of n-grams of a text as lists of feature numbers."""
    words = text.split()
    one = [xxhash.xxh64_intdigest(w, 7) // 4096 * 4096 + plain_shape(w) for w in words]
    form = [h % 4096 + (4096 if i and one[i - 1] == h else 0) for i, h in enumerate(one)]
    two = [((a * MIX & M) ^ b) * MIX & M for a, b in zip(one, one[1:])]
    single = [(f + (1 << 40)) * MIX & M for f in form]
    double = [(a ^ b) * MIX & M for a, b in zip(single, form[1:])]
    triple = [(a ^ b) * MIX & M for a, b in zip(double, form[2:])]
    return [[(h * MIX & M) >> 44 for h in grams] for grams in (one + two, single + double + triple)]


def plain_weight(z, n):
    return 0.0 if abs(z) <= quality.L1 else -(z - math.copysign(quality.L1, z)) / ((quality.BETA + math.sqrt(n)) / quality.ALPHA + quality.L2)


def plain_train(rows):
    z, n = defaultdict(float), defaultdict(float)
    for _ in range(quality.PASSES):
        for text, y in rows:
            x = [(0, 1.0)]
            for kind in plain_kinds(text):
                x += [(at, float(np.float32(times / max(1, len(kind))))) for at, times in sorted(Counter(kind).items())]
            w = [plain_weight(z[at], n[at]) for at, _ in x]
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(a * b for a, (_, b) in zip(w, x))))))
            changes = [(at, (p - y) * v, a) for a, (at, v) in zip(w, x)]
            grown = defaultdict(float)  # a feature of both kinds: the last of its changes counts, as in the vector form
            for at, g, a in changes:
                grown[at] = (z[at] + g - (math.sqrt(n[at] + g * g) - math.sqrt(n[at])) / quality.ALPHA * a, n[at] + g * g)
            for at, (new_z, new_n) in grown.items():
                z[at], n[at] = new_z, new_n
    return {at: plain_weight(z[at], n[at]) for at in z}


def plain_score(weights, text):
    total = weights.get(0, 0.0) + sum(sum(weights.get(at, 0.0) for at in kind) / max(1, len(kind)) for kind in plain_kinds(text))
    return 1 / (1 + math.exp(-max(-35, min(35, total))))


def test_scores_equal_the_plain_loop(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    order = quality.training_rows(docs, labels).withColumn("key", F.xxhash64("doc_id", F.lit("order"))).orderBy("key").collect()
    assert len(order) > 40
    weights = plain_train([(r["text"], r["y"]) for r in order])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    odd = spark.createDataFrame([(-1, None, 1), (-2, "", 1), (None, "no id at all", 1), (-3, "word " * 200_000, 1), (-3, "word " * 200_000, 1)],
                                "doc_id bigint, text string, score int")
    trained = quality.train(quality.training_rows(docs, labels))
    for r in quality.score(docs, trained).collect():
        assert r["score"] == pytest.approx(plain_score(weights, texts[r["doc_id"]]), abs=1e-9)
    got = quality.score(odd, trained).collect()
    assert len(got) == 5
    want = {-1: "", -2: "", None: "no id at all", -3: "word " * 200_000}
    assert all(r["score"] == pytest.approx(plain_score(weights, want[r["doc_id"]]), abs=1e-9) for r in got)
    kept = quality.keep_good(odd, trained)
    assert kept.columns == odd.columns and kept.count() == sum(r["score"] >= quality.THRESHOLD for r in got)
    assert quality.score(odd.limit(0), trained).count() == 0


def test_training_without_rows_and_with_odd_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 7), (1, 1), (1, 1), (1, 0)], "doc_id bigint, quality int")
    rows = quality.training_rows(docs, labels)
    assert sorted(map(tuple, rows.collect())) in ([(1, "a b", 1)], [])
    none = quality.train(rows.limit(0))
    assert [r["score"] for r in quality.score(docs, none).collect()] == [0.5, 0.5]
