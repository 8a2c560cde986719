"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import re
import weakref
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Blanks between words: space and the five ASCII control blanks, the same set that bytes.split() uses.
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
#: Rows of a batch handled at a time.
PART_ROWS = 1024


def narrowed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id bigint, text string): other columns are dropped, so that their names cannot clash; null texts are empty."""
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the name with as many underscores as make it no column of the frame in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_batches(df: DataFrame, work, schema: str) -> DataFrame:
    """Run ``work(batch) -> iterable of lists of columns`` over Arrow batches within the frame's own partitions."""
    fields = StructType.fromDDL(schema)
    names = fields.names

    def run(batches):
        for part in parts(batches):
            for columns in work(part):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return df.mapInArrow(frugal(run, work.__module__), fields)


def parts(batches):
    """Arrow batches in parts of at most PART_ROWS rows, so that Python copies of long texts stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def frugal(run, owner: str = ""):
    """``run`` as it is, then unused memory goes back to the system: workers live on and share it with other stages.

    What a worker remembers for operators of other modules than ``owner``, by default that of ``run``, goes first.
    """
    owner = owner or run.__module__

    def held(batches):
        forget_others(owner)
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not every C library has it
            pass

    return held


def whole_groups(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a key in one task and next to each other, for a streaming scan; nothing is gathered in memory."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *[F.expr(o.removesuffix(" desc")).desc() if o.endswith(" desc") else o for o in order])


def longs(column: pa.Array) -> np.ndarray:
    """A 64-bit integer column without nulls as numpy."""
    return column.to_numpy(zero_copy_only=False)


#: What this worker remembers, and by module what drops its other tables.
_remembered: list[weakref.ref] = []
_drops: dict[str, Callable[[], None]] = {}


def dropped_by(module: str, drop: Callable[[], None]) -> None:
    """Have ``drop`` called when a worker turns to another module's operator."""
    _drops[module] = drop


def forget_others(owner: str) -> None:
    """Empty what is remembered for other modules' operators: a worker that runs one operator after the other, as in a
    pipeline, then holds one operator's words and tables at a time."""
    for module, drop in _drops.items():
        if module != owner:
            drop()
    _remembered[:] = [r for r in _remembered if r() is not None]
    for found in [r() for r in _remembered]:
        if found is not None and found.make.__module__ != owner:
            found.clear()
            found.older = {}


class Remembered(dict):
    """Values made once for strings, of the most recently used about ``most`` of them; strings over 60 characters are
    made each time. One generation is looked up while the next one fills, so common strings stay."""

    def __init__(self, make, most: int):
        self.make, self.half, self.older = make, most // 2, {}
        _remembered.append(weakref.ref(self))

    def __missing__(self, key: str):
        if len(key) > 60:
            return self.make(key)
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found
