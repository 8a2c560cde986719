"""Exact dedup: colliding digests, a batch much larger than its snapshot, odd tables."""

import hashlib
import random

from pyspark.sql import functions as F

from vestigo.llm import exact_dedup

SCHEMA = "doc_id bigint, text string, digest string, shard int, old boolean"


def short(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:1]


def plain(rows):
    groups = {}
    for id, text in rows:
        body = (text or "").encode().lower()
        groups.setdefault(body, []).append(id)
    found = []
    for id, text in rows:
        ids = groups[(text or "").encode().lower()]
        keep = max((i for i in ids if i is not None), default=None)
        found.append((id, keep, len(ids), id is not None and id == keep))
    return sorted(found, key=repr)


def test_digests_that_collide(spark):
    draw = random.Random(2)
    rows = [(draw.choice([None, *range(200)]), draw.choice([None, "", "A", "a", *(f"Text {i}" for i in range(40))])) for _ in range(300)]
    rows += [(900, "long " * 200_000), (901, "LONG " * 200_000)]
    frame = spark.createDataFrame([(*r, "x", 1, True) for r in rows], SCHEMA)
    for digest in (short, exact_dedup.sha256):
        got = exact_dedup.exact_dedup(frame, F.col("doc_id") % 3 == 0, digest).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=repr) == plain(rows)
    assert exact_dedup.exact_dedup(frame.limit(0), F.lit(True)).collect() == []


def test_large_batch_against_a_small_snapshot(spark):
    snapshot = exact_dedup.build_snapshot(exact_dedup.digests(spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id bigint, text string")))
    batch = exact_dedup._groups(exact_dedup.digests(spark.createDataFrame([(i, f"t{i}") for i in range(2000)], "doc_id bigint, text string")))
    known = {exact_dedup.sha256(f"t{i}".encode()) for i in range(50)}
    for most in (1, 10, 1 << 16):
        found = {r["digest"] for r in exact_dedup.screen(batch, snapshot, most).collect()}
        assert known <= found and len(found) < 200
