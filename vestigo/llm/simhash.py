"""Near-duplicates by SimHash, linked with covering locality-sensitive hashing.

A fingerprint has a bit for each majority among the bits of its shingles' hashes. To find all pairs within a radius r,
every bit is given a vector of r + 1 bits; each of the 2^(r+1) - 1 non-zero vectors v makes a mask of the bits whose
vector has an odd product with v (Pagh, 2016). The vectors of r differing bits leave some v orthogonal to all of
them, so any pair within the radius agrees under that mask and meets in its table: no pair is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigo.llm.common import by_batches, frugal, longs, narrowed, whole_groups
from vestigo.llm.components import components
from vestigo.sources.tables import written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of one bucket compared in one task; larger buckets are covered anew by their remaining bits.
BUCKET = 2048
#: After this many coverings a bucket agrees in all but a few bits, so it has few different fingerprints.
LEVELS = 4

_VALUES = np.arange(256, dtype=np.uint8)
_BYTE_BITS = np.unpackbits(_VALUES[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``width`` words of a text in ASCII lower case; of all its words when there are fewer."""
    words = text.encode().lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    runs = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(r, SEED) for r in runs), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """64 majority bits, as a signed number; zero without hashes."""
    if not len(hashes):
        return 0
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BYTE_BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; null texts are empty, texts without words have fingerprint 0."""
    def work(batch):
        texts = batch.column(1)
        yield batch.column(0), np.fromiter((fingerprint(shingle_hashes(t.as_py(), width)) for t in texts), np.int64, len(texts))

    return by_batches(narrowed(docs), work, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, level: int = 0) -> list[int]:
    """Masks, as signed numbers, such that two fingerprints within the radius agree under at least one.

    The vectors go round over the bits in an order that depends on the level, so that each mask has about half the bits.
    """
    vectors = 2 ** (radius + 1) - 1
    order = np.random.default_rng(level).permutation(64)
    masks = []
    for v in range(1, vectors + 1):
        mask = sum(1 << int(bit) for at, bit in enumerate(order) if bin((at % vectors + 1) & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _tables(rows: DataFrame, radius: int, level: int, *within: str) -> DataFrame:
    """(bucket, fp, node): each fingerprint once in every table of a covering."""
    keys = [F.xxhash64(*within, F.lit(level), F.lit(i), F.col("fp").bitwiseAND(F.lit(m)))
            for i, m in enumerate(covering_masks(radius, level))]
    return rows.select(F.explode(F.array(*keys)).alias("bucket"), "fp", "node")


def forest(values: np.ndarray, radius: int) -> np.ndarray:
    """For every value the place of the first value it is connected to by steps within the radius."""
    values = values.view(np.uint64)  # numpy counts the bits of a negative number's absolute value
    root = np.full(len(values), -1)
    for start in range(len(values)):
        if root[start] >= 0:
            continue
        root[start], front = start, np.array([start])
        while len(front):
            free = np.flatnonzero(root < 0)
            near = np.zeros(len(free), bool)
            for at in range(0, len(front), 256):
                near |= (np.bitwise_count(values[front[at:at + 256], None] ^ values[free]) <= radius).any(axis=0)
            front = free[near]
            root[front] = start
    return root


def _bucket_links(batches, radius: int):
    """Edges that connect what is connected within each bucket, from rows sorted by bucket."""
    kept = [np.zeros(0, np.int64)] * 3

    def edges(bucket, fp, node):
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(bucket)])
        two = starts[sizes == 2]
        close = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius]
        a, b = [node[close + 1]], [node[close]]
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            root = forest(fp[at:at + n], radius)
            linked = np.flatnonzero(root != np.arange(n))
            a.append(node[at + linked])
            b.append(node[at + root[linked]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kept = [np.r_[k, longs(c)] for k, c in zip(kept, batch.columns)]
        last = len(kept[0]) - int((kept[0] == kept[0][-1]).sum())
        yield edges(*[k[:last] for k in kept])
        kept = [k[last:] for k in kept]
    yield edges(*kept)


def near_links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect exactly the nodes connected by pairs within the radius.

    ``nodes`` has distinct rows (fp, node). A bucket's rows stream through one task; a bucket of more than ``bucket``
    rows goes to the next covering instead, which splits it by half of its remaining bits, and a pair of it meets there.
    """
    found, rows = [], _tables(nodes, radius, 0)
    for level in range(LEVELS):
        large = None
        if level < LEVELS - 1:
            large = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("bucket"), "large")
            large = None if large.isEmpty() else large
        small = rows if large is None else rows.join(large, "bucket", "left_anti")
        found.append(whole_groups(small, ["bucket"], ["node"])
                     .mapInArrow(frugal(lambda batches: _bucket_links(batches, radius)), "a long, b long"))
        if large is None:
            break
        rows = _tables(written(rows.join(large, "bucket"), "rest"), radius, level + 1, "bucket")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def simhash_components(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component) of every row: the least id reachable over links within the radius.

    Equal fingerprints are one node. Null texts are empty; all texts without words have fingerprint 0 and link with
    each other and with fingerprints of at most ``radius`` bits. Repeated ids are one document per fingerprint; rows
    without an id take part through other rows of their fingerprint only, and have a null component when there is none.
    """
    rows = written(fingerprints(docs, width), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(near_links(nodes.filter("node is not null"), radius, bucket), "a", "b")
    named = written(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component")), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component")
