"""Exact dedup of a new batch against an immutable snapshot, screened by static binary-fuse filters.

A snapshot keeps one row per different text and, for each shard of its digests, a binary-fuse filter (Graf and Lemire,
2022): three probes a digest, about nine bits each, no false negatives. Digests of a new batch are grouped among
themselves first. A filter then says which of them can be in the snapshot at all; only those are joined with the
snapshot's digest buckets. Groups of more than one row are compared byte by byte, by grouping whole texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigo.llm.common import by_batches, longs, narrowed
from vestigo.sources.tables import written

KEYS_PER_SHARD = 1 << 16
LEAST_SHARDS = 64
FILTER = "shard int, seed long, segment int, segments int, cells binary"


class Snapshot(NamedTuple):
    """``groups`` (digest, keep_id, n), one row per digest; ``filters``, one row per shard."""

    groups: DataFrame
    filters: DataFrame
    shards: int


# --- the filter

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3) cells of each key, in three neighbouring segments, and its 8-bit fingerprint."""
    with np.errstate(over="ignore"):
        h = keys.view(np.uint64) + np.uint64(seed) * _MIX[0]
        h = (h ^ (h >> np.uint64(30))) * _MIX[1]
        h = (h ^ (h >> np.uint64(27))) * _MIX[2]
        h ^= h >> np.uint64(31)
    first = ((h >> np.uint64(32)) * np.uint64(segment * segments) >> np.uint64(32)).astype(np.int64)
    inner = segment - 1
    low = h.astype(np.int64)
    return (np.stack([first, (first + segment) ^ ((low >> 18) & inner), (first + 2 * segment) ^ (low & inner)], axis=1),
            ((h >> np.uint64(40)) & np.uint64(255)).astype(np.uint8))


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, cells) of distinct 64-bit keys, by peeling cells that one key alone uses."""
    n = len(keys)
    segment = 1 << min(18, max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / segment) - 2)
    for seed in range(1, 1000):
        slots, prints = _slots(keys, seed, segment, segments)
        size = (segments + 2) * segment
        uses = np.bincount(slots.ravel(), minlength=size)
        owner = np.bincount(slots.ravel(), weights=np.repeat(np.arange(n, dtype=float), 3), minlength=size)
        rounds, left, lone = [], n, np.flatnonzero(uses == 1)
        while len(lone):
            who, at = np.unique(owner[lone].astype(np.int64), return_index=True)
            rounds.append((who, lone[at]))
            left -= len(who)
            cells = slots[who].ravel()
            np.subtract.at(uses, cells, 1)
            np.subtract.at(owner, cells, np.repeat(who.astype(float), 3))
            cells = np.unique(cells)
            lone = cells[uses[cells] == 1]
        if not left:
            table = np.zeros(size, np.uint8)
            for who, cell in reversed(rounds):
                table[cell] = 0
                table[cell] = prints[who] ^ np.bitwise_xor.reduce(table[slots[who]], axis=1)
            return seed, segment, segments, table.tobytes()
        if seed % 20 == 0:
            segments += 1 + segments // 8
    raise ValueError("keys of a filter must be distinct")


def in_filter(keys: np.ndarray, seed: int, segment: int, segments: int, cells: bytes) -> np.ndarray:
    """Whether each key can be in the filter: always true for its own keys, true for about 1 in 256 others."""
    slots, prints = _slots(keys, seed, segment, segments)
    return prints == np.bitwise_xor.reduce(np.frombuffer(cells, np.uint8)[slots], axis=1)


# --- digests and groups

def lowered(text: str) -> bytes:
    """UTF-8 of a text with A-Z, and nothing else, in lower case."""
    return text.encode().lower()


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def digests(docs: DataFrame, digest: Callable[[bytes], str] = sha256) -> DataFrame:
    """(doc_id, digest) of every row; a null text counts as empty."""
    def work(batch):
        yield batch.column(0), pa.array([digest(lowered(t)) for t in batch.column(1).to_pylist()], pa.string())

    return by_batches(narrowed(docs), work, "doc_id long, digest string")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _keyed(groups: DataFrame, shards: int) -> DataFrame:
    return groups.select(_shard(shards).alias("shard"), F.xxhash64(F.lit("key"), "digest").alias("key"), "digest")


def build_snapshot(rows: DataFrame) -> Snapshot:
    """Snapshot of (doc_id, digest) rows: groups and filters are written once and never changed."""
    groups = written(_groups(rows), "snapshot")
    shards = max(LEAST_SHARDS, math.ceil(groups.count() / KEYS_PER_SHARD))

    def build(key, table):
        keys = np.unique(table.column("key").to_numpy())
        return pa.Table.from_pylist([dict(zip(("shard", "seed", "segment", "segments", "cells"),
                                              (key[0].as_py(), *build_filter(keys))))],
                                    pa.schema([("shard", pa.int32()), ("seed", pa.int64()), ("segment", pa.int32()),
                                               ("segments", pa.int32()), ("cells", pa.binary())]))

    filters = _keyed(groups, shards).select("shard", "key").groupBy("shard").applyInArrow(build, FILTER)
    return Snapshot(groups, written(filters, "filters"), shards)


def screen(groups: DataFrame, snapshot: Snapshot, most: int = KEYS_PER_SHARD) -> DataFrame:
    """Those digests of a batch's groups that can be in the snapshot.

    A shard's filter meets the batch's digests of the shard in as many parts as keep about ``most`` digests in each, so
    that a batch much larger than the snapshot fills no task.
    """
    parts = max(1, math.ceil(groups.count() / (snapshot.shards * most)))
    part = F.pmod(F.xxhash64(F.lit("part"), "digest"), F.lit(parts)).cast("int").alias("part")
    filters = snapshot.filters.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def check(key, batch, filters):
        found = filters.to_pylist()
        keep = (in_filter(longs(batch.column("key").combine_chunks()), *[found[0][n] for n in
                ("seed", "segment", "segments", "cells")]) if found else np.zeros(batch.num_rows, bool))
        return batch.select(["digest"]).filter(pa.array(keep))

    return (_keyed(groups, snapshot.shards).select("*", part).groupBy("shard", "part")
            .cogroup(filters.groupBy("shard", "part")).applyInArrow(check, "digest string"))


def _texts(docs: DataFrame, digest: Callable[[bytes], str]) -> DataFrame:
    """(digest, body, keep_id, n): whole texts, equal ones of an Arrow batch already merged."""
    def work(batch):
        merged: dict[bytes, list] = {}
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            row = merged.setdefault(lowered(text), [None, 0])
            row[0] = i if row[0] is None else row[0] if i is None else max(row[0], i)
            row[1] += 1
        yield ([digest(b) for b in merged] or pa.array([], pa.string()), pa.array(list(merged), pa.binary()),
               pa.array([r[0] for r in merged.values()], pa.int64()), pa.array([r[1] for r in merged.values()], pa.int64()))

    return by_batches(narrowed(docs), work, "digest string, body binary, keep_id long, n long")


def exact_dedup(docs: DataFrame, in_snapshot: Column, digest: Callable[[bytes], str] = sha256) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) of every row of ``docs``.

    Rows for which ``in_snapshot`` holds form the immutable snapshot, the others the new batch. Texts are equal when
    they are the same after lower-casing A-Z; null texts are empty, and empty texts equal each other. Of equal texts
    the largest id stays. Repeated rows of one id share its decision; rows without an id count in their group but
    never stay, and a group of such rows alone has a null keep_id. An empty table gives no rows.

    The digest screens and joins; whether texts are equal is decided on their bytes, so a digest with collisions
    changes the cost and not the result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
                        F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    old = digests(plain.filter("old"), digest).withColumn("old", F.lit(True))
    rows = written(old.unionByName(digests(plain.filter("not old"), digest).withColumn("old", F.lit(False))), "digests")
    snapshot = build_snapshot(rows.filter("old"))
    new = written(_groups(rows.filter("not old")), "batch")

    positive = screen(new, snapshot)
    matched = written(positive.join(new, "digest").select("digest", F.col("keep_id").alias("new_id"), F.col("n").alias("new_n"))
                      .join(snapshot.groups, "digest")
                      .select("digest", F.greatest("keep_id", "new_id").alias("keep_id"), (F.col("n") + F.col("new_n")).alias("n")),
                      "matched")
    groups = written(matched.unionByName(snapshot.groups.join(matched, "digest", "left_anti"))
                     .unionByName(new.join(matched, "digest", "left_anti")), "groups")

    bodies = written(_texts(plain, digest).join(groups.filter("n > 1").select("digest"), "digest", "left_semi")
                     .groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
                     .select("digest", F.sha2("body", 256).alias("sha"), F.length("body").alias("bytes"), "keep_id", "group_size"),
                     "bodies")
    apart = bodies.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    sized = groups.select("digest", "keep_id", F.col("n").alias("group_size"))
    out = rows.drop("old")
    if not apart.isEmpty():
        return _kept(_by_body(plain, digest, written(apart, "apart"))).unionByName(
            _kept(out.join(sized.join(apart, "digest", "left_anti"), "digest")))
    return _kept(out.join(sized, "digest"))


def _by_body(docs: DataFrame, digest, apart: DataFrame) -> DataFrame:
    """Groups by whole text of the rows whose digest several texts share."""
    def work(batch):
        bodies = [lowered(t) for t in batch.column(1).to_pylist()]
        yield batch.column(0), pa.array([digest(b) for b in bodies], pa.string()), pa.array(bodies, pa.binary())

    rows = written(by_batches(narrowed(docs), work, "doc_id long, digest string, body binary")
                   .join(apart, "digest", "left_semi"), "collisions")
    groups = rows.groupBy("digest", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["digest", "body"]).drop("body")


def _kept(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "digest", "keep_id", "group_size",
                       F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"))
