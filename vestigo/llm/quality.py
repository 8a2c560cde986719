"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-Proximal updates.

A text's features are its hashed n-grams: single words and pairs of words, and runs of one to three word shapes (case,
punctuation, and whether the word repeats the one before). A feature's value is its share among the n-grams of its kind;
there is a constant too. Training goes over a bounded sample of labelled rows, document by document (McMahan et al., 2013);
scoring is a sparse dot product with the weights, in every task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigo.llm.common import Remembered, by_batches, frugal, narrowed, parts
from vestigo.sources.tables import written

BITS = 20
#: Largest number of labelled rows trained on, the first by hash of their id.
TRAIN_ROWS = 20_000
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 0.02, 0.1, 3
THRESHOLD = 0.3
FOLDS = 5
KEPT_WORDS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> int:
    """A word's case and the punctuation in it, as a number below 4096."""
    case = 0 if word.upper() == word.lower() else 1 if word.islower() else 3 if word.isupper() else 2 if word.istitle() else 4
    marks = "".join(c for c in word if not c.isalnum())
    return case << 9 | (zlib.crc32(marks.encode()) % 511 + 1 if marks else 0)


def _hash(word: str) -> bytes:
    """Hash of a word, with its shape in the low 12 bits."""
    return (xxhash.xxh64_intdigest(word, 7) & ~0xFFF | shape(word)).to_bytes(8, "little")


_hashes = Remembered(_hash, KEPT_WORDS)


def ngrams(text: str) -> list[np.ndarray]:
    """Feature numbers of a text's word n-grams and of its shape n-grams, repeats included."""
    words = text.split()
    one = np.frombuffer(b"".join(map(_hashes.__getitem__, words)), np.uint64)
    form = one & np.uint64(0xFFF)
    form[1:] |= (one[1:] == one[:-1]).astype(np.uint64) << np.uint64(12)
    with np.errstate(over="ignore"):
        two = (one[:-1] * _MIX ^ one[1:]) * _MIX
        single = (form + np.uint64(1 << 40)) * _MIX
        double = (single[:-1] ^ form[1:]) * _MIX
        triple = (double[:-1] ^ form[2:]) * _MIX
        return [(np.concatenate(b) * _MIX >> np.uint64(64 - BITS)).astype(np.int32) for b in ((one, two), (single, double, triple))]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, values) of a text's features, each once: its share of its kind's n-grams; number 0 is the constant."""
    at, x = [np.zeros(1, np.int32)], [np.ones(1)]
    for block in ngrams(text):
        seen, times = np.unique(block, return_counts=True)
        at.append(seen)
        x.append(times / max(1, len(block)))
    return np.concatenate(at), np.concatenate(x)


def held_out(id: Column, folds: int = FOLDS) -> Column:
    """Whether an id's CRC32, as decimal text, falls in fold 0; false without an id."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled rows outside the held-out fold, in order of their hash.

    Labels other than 0 and 1, and rows without id or label, are not used; a label row given twice is used once.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
             .filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")))
    chosen = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit), "labelled")
    return narrowed(docs).join(F.broadcast(chosen), "doc_id")  # at most ``limit`` rows of 12 bytes


def chance(sums):
    return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))


class Ftrl:
    """FTRL-Proximal over hashed features."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        gradient = (chance(w @ x) - y) * x
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more


def train(rows: DataFrame, passes: int = PASSES) -> np.ndarray:
    """Weights from rows (doc_id, text, y): features are made in all tasks, updates run in one over the bounded sample.

    That task holds the sample's features, about 8 bytes each, and puts them in an order that depends on the ids alone.

    Without rows all weights are 0, and every score is a half.
    """
    def extract(batch):
        found = [features(t.as_py()) for t in batch.column(1)]
        ends = pa.array(np.cumsum([0] + [len(at) for at, _ in found]).astype(np.int32))
        yield (batch.column(0), *[pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c).astype(t.to_pandas_dtype()) if c else [], t))
                                  for c, t in zip(list(zip(*found)) or [(), ()], (pa.int32(), pa.float32()))], batch.column(2))

    sparse = written(by_batches(rows.select("doc_id", "text", "y"), extract, "doc_id long, at array<int>, x array<float>, y int"),
                     "features")

    def learn(batches: Iterator[pa.RecordBatch]):
        rows = []
        for batch in batches:
            for key, at, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                rows.append((key, at.values.to_numpy().copy(), x.values.to_numpy().astype(np.float32), y))
        rows.sort(key=lambda row: row[0])
        model = Ftrl(1 << BITS)
        for _ in range(passes):
            for _, at, x, y in rows:
                model.update(at, x.astype(float), y)
        w = model.weights(slice(None))
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(w[used])], ["at", "w"])

    order = F.xxhash64("doc_id", F.lit("order")).alias("key")
    table = sparse.select(order, "at", "x", "y").coalesce(1).mapInArrow(frugal(learn), "at long, w double").toPandas()
    weights = np.zeros(1 << BITS)
    weights[table["at"].to_numpy(dtype=np.int64)] = table["w"].to_numpy()
    return weights


def _sums(weights: np.ndarray, texts) -> np.ndarray:
    """Sparse dot products; a text's repeated n-grams are summed where they stand."""
    return np.array([weights[0] + sum(weights[b].sum() / max(1, len(b)) for b in ngrams(t)) for t in texts], float)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row, 0 to 1; null texts are empty and score by the constant alone.

    The weights have a fixed size of 2^BITS numbers and go to every executor.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def work(batch):
        yield batch.column(0), chance(_sums(shared.value, (t.as_py() for t in batch.column(1))))

    return by_batches(narrowed(docs), work, "doc_id long, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least the threshold; scored and kept in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    at = docs.columns.index(text)

    def run(batches):
        for batch in parts(batches):
            sums = _sums(shared.value, (t.as_py() or "" for t in batch.column(at)))
            yield batch.filter(pa.array(chance(sums) >= threshold))

    return docs.mapInArrow(frugal(run), docs.schema)


def predicted(score: Column) -> Column:
    return (score >= THRESHOLD).cast("int")
