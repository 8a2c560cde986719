"""Near-duplicate lines by a segment-partition edit join (Li, Deng, Wang and Feng, 2011).

Two lines within t edits share a segment: cut the shorter into t + 1 segments, and one of them is a substring of the
longer, at a start that lies within bounds set by the segment's number and the difference in length. Every line is
put under its segments and looks up, for each length it may match, the substrings at those starts. Lines that meet
are compared with a bit-parallel edit distance that follows the 2t + 1 diagonals of the band.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigo.llm.common import by_batches, frugal, longs, narrowed, parts, unused, whole_groups
from vestigo.llm.components import components
from vestigo.sources.tables import written

EDITS = 2
#: Lines with fewer characters repeat by exact copies only: two edits would join lines that say different things.
LEAST_CHARS = 20
#: Lines of one key compared in one task; the lines of a larger key are compared block by block in several.
BLOCK = 512
#: Lines of which a task holds the rows, however many its texts have.
HELD_LINES = 50_000
#: What a text with only single blanks between the words of its lines does not hold.
UNTIDY = (b"\t", b"\r", b"\x0b", b"\x0c", b"  ", b" \n", b"\n ")
#: Lines and characters of which a task makes the keys at a time.
KEYED_LINES, KEYED_CHARS = 16_384, 1 << 18
#: Bits by which lines are sifted before their texts are handed on: a power of 2 from 64 on.
SIFT_BITS = 1 << 25


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of edits + 1 segments of nearly equal size, shorter ones first."""
    size, longer = divmod(length, edits + 1)
    found, at = [], 0
    for k in range(edits + 1):
        now = size + (k > edits - longer)
        found.append((at, now))
        at += now
    return found


class Probes(NamedTuple):
    """Substrings that a line of one length looks up among lines up to ``edits`` shorter, and its own segments: begin, stop,
    seed, whether it is an own segment, and the place of the own segment with the same seed, else the probe's own place."""

    begin: np.ndarray
    stop: np.ndarray
    seed: np.ndarray
    own: np.ndarray
    twin: np.ndarray


@lru_cache(maxsize=4096)
def probes(n: int, edits: int) -> Probes:
    """The probes of a line of n characters; they depend on the length alone."""
    rows = []
    for length in range(max(edits + 1, n - edits), n + 1):
        more = n - length
        for k, (start, size) in enumerate(segments(length, edits)):
            low = max(0, start - k, start + more - (edits - k))
            high = min(n - size, start + k, start + more + (edits - k))
            rows += [(at, at + size, length * 64 + k, length == n and at == start) for at in range(low, high + 1)]
    own = {seed: i for i, (_, _, seed, mine) in enumerate(rows) if mine}
    begin, stop, seed, mine = (np.array(c, np.int64) for c in (zip(*rows) if rows else [()] * 4))
    return Probes(begin, stop, seed, mine.astype(bool), np.array([own.get(s, i) for i, s in enumerate(seed.tolist())], np.int64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers spread over 64 bits; different ones stay different."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo 2 to the 64."""
    base = 0x9E3779B97F4A7C15
    both = []
    for x in (base, pow(base, -1, 1 << 64)):
        row = np.full(n, x, np.uint64)
        row[:1] = 1
        both.append(np.cumprod(row, dtype=np.uint64))
    return both[0], both[1]


def line_keys(lines: list[tuple[int, bytes]], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, own, place) of lines given as (characters, text): the keys of their own segments, and those they look up, with the
    line's place in the list. A key is the hash of a substring, as a polynomial of its code points, and of its seed; the sums
    of the polynomial up to each character give every substring's."""
    sizes = np.array([n for n, _ in lines], np.int64)
    text = b"".join(line for _, line in lines)
    points = np.frombuffer(text, np.uint8) if text.isascii() else np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    up, down = _powers(1 << max(19, len(points).bit_length()))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points * down[:len(points)], out=sums[1:])
    starts = np.cumsum(sizes) - sizes
    lengths, kind = np.unique(sizes, return_inverse=True)
    of = [probes(n, edits) for n in lengths.tolist()]
    begin, stop, seed, own, twin = (np.concatenate(c) for c in zip(*of))
    width = np.array([len(x.seed) for x in of])
    place = np.repeat(np.arange(len(lines)), width[kind])
    ends = np.cumsum(width[kind])
    row = np.arange(len(place)) - (ends - width[kind])[place]
    at = (np.cumsum(width) - width)[kind][place] + row
    first, own, twin = starts[place], own[at], np.arange(len(place)) - row + twin[at]
    begin, stop, seed = first + begin[at], first + stop[at], seed[at]
    key = _mixed(_mixed((sums[stop] - sums[begin]) * up[begin]) ^ seed.astype(np.uint64))
    once = own | (twin == np.arange(len(key))) | (key[twin] != key)  # a line looks up none of its own segments
    return key[once], own[once], place[once]


def within(a: str, b: str, edits: int) -> bool:
    """Whether two strings are at most ``edits`` insertions, deletions and replacements apart.

    Equal ends are cut off. Then bit d of the set for e edits says that a[:i] and b[:i + d - edits] are within e.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    n, least = 0, min(len(a), len(b))
    while n < least and a[n:n + 64] == b[n:n + 64] and n + 64 <= least:
        n += 64
    while n < least and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    n, least = 0, min(len(a), len(b))
    while n + 64 <= least and a[len(a) - n - 64:len(a) - n] == b[len(b) - n - 64:len(b) - n]:
        n += 64
    while n < least and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[:len(a) - n], b[:len(b) - n]
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << (j + edits)
    band = (1 << 2 * edits + 1) - 1
    sets = [0] * (edits + 1)
    sets[0] = 1 << edits
    for e in range(1, edits + 1):
        sets[e] = sets[e - 1] | (sets[e - 1] << 1) & band
    for i, c in enumerate(a):
        equal = places.get(c, 0) >> i & band
        last, sets[0] = sets[0], sets[0] & equal
        for e in range(1, edits + 1):
            now = sets[e]
            sets[e] = (now & equal | last | last >> 1 | sets[e - 1] << 1) & band
            last = now
        if not sets[edits]:
            return False
    return bool(sets[edits] >> (len(b) - len(a) + edits) & 1)


def _lines(text: bytes):
    """(number, begin, stop, normalised line) of the lines with a word: ASCII lower case, one blank between words. Offsets are
    characters."""
    at, ascii_only, tidy = 0, text.isascii(), text[:1] != b" " and text[-1:] != b" " and not any(x in text for x in UNTIDY)
    for k, line in enumerate(text.lower().split(b"\n")):
        n = len(line) if ascii_only else len(line.decode())
        plain = line if tidy else b" ".join(line.split())
        if plain:
            yield k, at, at + n, plain
        at += n + 1


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, line, begin, stop, digest binary) of every line with a word."""
    def work(batch):
        held, md5 = [], hashlib.md5
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            for k, begin, stop, plain in _lines(text.as_py()):
                held.append((i, k, begin, stop, md5(plain).digest()))
                if len(held) == HELD_LINES:
                    yield columns(held)
                    held = []
        yield columns(held)

    def columns(held):
        return [pa.array(list(c), pa.binary() if k == 4 else pa.int64()) for k, c in enumerate(zip(*held) if held else [()] * 5)]

    return by_batches(narrowed(docs), work, "doc_id long, line long, begin long, stop long, digest binary")


def _different(batch, least_chars: int) -> set[bytes]:
    """The normalised lines of a batch's texts with enough characters, each once."""
    found = {plain for text in batch.column(1).cast(pa.binary()) for _, _, _, plain in _lines(text.as_py()) if len(plain) >= least_chars}
    return {p for p in found if p.isascii() or len(p) >= 4 * least_chars or len(p.decode()) >= least_chars}


def number(line: bytes) -> int:
    """63 bits of a line's hash. Lines of one number meet as candidates together: it never takes a line's place in a result."""
    return xxhash.xxh64_intdigest(line) >> 1


def keyed_lines(docs: DataFrame, edits: int, least_chars: int) -> DataFrame:
    """(key, line): the keys of every line, equal lines of a part of a batch once. ``line`` is the line's number, made
    negative by its highest bit where the key is that of an own segment."""
    def work(batch):
        lines = sorted((len(p) if p.isascii() else len(p.decode()), p) for p in _different(batch, least_chars))
        lines = lines[bisect_left(lines, (edits + 1,)):]  # shorter ones have no segments
        while lines:
            ends = np.cumsum([n for n, _ in lines[:KEYED_LINES]])
            some = max(1, int(np.searchsorted(ends, KEYED_CHARS, side="right")))
            key, own, place = line_keys(lines[:some], edits)
            numbers = np.array([number(p) for _, p in lines[:some]], np.uint64)
            yield key.view(np.int64), (numbers[place] | own.astype(np.uint64) << np.uint64(63)).view(np.int64)
            lines = lines[some:]

    return by_batches(narrowed(docs), work, "key long, line long")


def _shared_keys(batches):
    """Rows of the keys under which a line's segment meets another line, each once, from rows sorted by key and line.

    Own segments are negative, so they come first: a key without them starts with another row. Only the last row of a
    key is held from batch to batch, so a key's rows may be any number.
    """
    last, held, live = None, None, False  # the last row; whether it waits for a second of its key; whether its key is passed on
    for batch in batches:
        key, line = longs(batch.column(0)), longs(batch.column(1))
        fresh = np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])][:len(key)]
        if len(key) and last == (key[0], line[0]):
            fresh[0] = False
        key, line = key[fresh], line[fresh]
        if not len(key):
            continue
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        wanted = (sizes > 1) & (line[starts] < 0)
        goes_on = last is not None and last[0] == key[0]
        waits = (sizes[-1] == 1 and line[-1] < 0)
        if goes_on:
            wanted[0] = live or held
            waits &= len(starts) > 1
        some = np.repeat(wanted, sizes)
        out = key[some], line[some]
        if goes_on and held:
            out = np.r_[last[0], out[0]], np.r_[last[1], out[1]]
        last, held, live = (key[-1], line[-1]), bool(waits), bool(wanted[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["key", "line"])


def _sieve(lines: DataFrame, bits: int = SIFT_BITS) -> np.ndarray:
    """One of ``bits`` bits set for each line number, in words of 64: the same size for any number of lines."""
    words = lines.groupBy(F.expr(f"shiftrightunsigned(line, 6) & {bits // 64 - 1}L").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(line & 63L as int)))").alias("word")).toArrow()
    sieve = np.zeros(bits // 64, np.uint64)
    sieve[words["at"].to_numpy()] = words["word"].to_numpy().view(np.uint64)
    return sieve


def _sifted(sieve: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Places of the numbers whose bit is set: all those the sieve was made of, and a few others."""
    words = sieve[(numbers >> np.uint64(6) & np.uint64(len(sieve) - 1)).astype(np.int64)]
    return np.flatnonzero(words >> (numbers & np.uint64(63)) & np.uint64(1))


def _compare(batches, edits: int):
    """(a, b): a forest over the lines of each group that are within ``edits``; rows come sorted by group."""
    group, rows = None, []

    def links():
        first, a, b = list(range(len(rows))), [], []

        def root(i):
            while first[i] != i:
                first[i] = first[first[i]]
                i = first[i]
            return i

        for i, (own, side, digest, line) in enumerate(rows):
            for j in range(i):
                o, s, d, l = rows[j]
                if (own or o) and (side != s or side < 0) and root(i) != root(j) and d != digest and within(line, l, edits):
                    first[root(i)] = root(j)
                    a.append(digest)
                    b.append(d)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    for batch in batches:
        for g, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if g != group:
                if len(rows) > 1:
                    yield links()
                group, rows = g, []
            rows.append(row)
    if len(rows) > 1:
        yield links()


def line_links(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS, block: int = BLOCK) -> DataFrame:
    """(a, b) digests of different lines: links that connect exactly the lines connected by pairs within ``edits``."""
    shared = (written(whole_groups(keyed_lines(docs, edits, least_chars), ["key"], ["line"])
                      .mapInArrow(frugal(_shared_keys), "key long, line long"), "shared")
              .select("key", F.expr("line < 0").alias("own"), F.expr(f"line & {2 ** 63 - 1}L").alias("line")))
    wanted = shared.select("line").distinct()
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(wanted))

    def work(batch):
        found = list(_different(batch, least_chars))
        numbers = np.array([number(p) for p in found], np.uint64)
        some = _sifted(sieve.value, numbers)
        found = [found[i] for i in some]
        yield (numbers[some].astype(np.int64), pa.array([hashlib.md5(p).digest() for p in found], pa.binary()),
               pa.array(found, pa.binary()).cast(pa.string()))

    # The sieve leaves few others; both sides of the join that drops those grow with the texts, so neither is broadcast.
    texts = (by_batches(narrowed(docs), work, "line long, digest binary, body string")
             .join(wanted.hint("shuffle_hash"), "line", "left_semi")
             .groupBy("line", "digest").agg(F.first("body").alias("body")))
    members = shared.select(F.col("key").alias("cell"), F.lit(-1).alias("side"), "own", "line")
    large = written(shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block), "large")
    if not large.isEmpty():
        parts = F.ceil(F.col("n") / block).cast("int")
        mine = F.pmod(F.xxhash64("line"), parts.cast("long")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        split = (shared.join(large, "key").withColumn("parts", parts).withColumn("mine", mine).withColumn("other", other)
                 .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"),
                         F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine")).alias("side"), "own", "line"))
        members = members.join(large.withColumnRenamed("key", "cell"), "cell", "left_anti").unionByName(split)
    rows = members.join(texts.hint("merge"), "line").select("cell", "own", "side", "digest", "body")
    return whole_groups(rows, ["cell"], ["digest"]).mapInArrow(frugal(lambda b: _compare(b, edits)), "a binary, b binary").distinct()


def line_classes(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS, block: int = BLOCK) -> DataFrame:
    """(doc_id, line, begin, stop, first_doc_id, first_line, kept) of every line with a word.

    Lines are compared in ASCII lower case with single blanks between words. Lines of ``least_chars`` characters or more
    that are connected by steps of at most ``edits`` edits are one class; shorter lines are one class when they are
    equal. A class's occurrence with the smallest (doc_id, line) stays. Offsets are characters of the original text.
    Lines of blanks, null and empty texts give no rows; rows without an id are left out. Repeated ids: lines of one
    (doc_id, line) share their place, and all occurrences at the first place stay.
    """
    docs = docs.filter("doc_id is not null")
    rows = written(occurrences(docs), "lines")
    classes = written(components(line_links(docs, edits, least_chars, block), "a", "b"), "classes")
    place = F.struct(F.col("doc_id").alias("doc_id"), F.col("line").alias("line"))
    by_text = rows.groupBy("digest").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"))
    places = written(by_text.join(classes.withColumnRenamed("node", "digest").hint("merge"), "digest", "left"), "places")
    linked = places.filter("component is not null")
    firsts = linked.groupBy("component").agg(F.min("place").alias("first"))
    known = (linked.join(firsts.hint("merge"), "component").select("digest", "first")
             .unionByName(places.filter("component is null and n > 1").select("digest", F.col("place").alias("first"))))
    joined = rows.join(known.hint("merge"), "digest", "left")
    first = F.coalesce("first", place)
    return joined.select("doc_id", "line", "begin", "stop", first["doc_id"].alias("first_doc_id"), first["line"].alias("first_line"),
                         (first == place).alias("kept"))


def without_lines(docs: DataFrame, removed: DataFrame, id: str = "doc_id") -> DataFrame:
    """``docs`` without the lines (doc_id, line) of ``removed``; other documents are unchanged, n_chars is kept in step.

    ``id`` is the column of ``docs`` that ``removed`` names as doc_id; a line goes from every row of its id. Columns of
    ``docs`` may have any names.
    """
    names = docs.columns
    of, lines = unused(docs, "gone_id"), unused(docs, "gone")
    gone = removed.groupBy(F.col("doc_id").alias(of)).agg(F.collect_set("line").alias(lines))
    joined = docs.join(gone, F.col(f"`{id}`") == F.col(of), "left")
    at = names.index("text")

    def run(batches):
        for batch in parts(batches):
            texts = []
            for text, cut in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                if cut:
                    cut = set(cut)
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in cut)
                texts.append(text)
            columns = batch.columns[:len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = joined.select(*[F.col(f"`{c}`") for c in names], lines).mapInArrow(frugal(run), docs.schema)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else rows
