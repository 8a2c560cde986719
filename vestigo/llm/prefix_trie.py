"""Prefix trie of conversations from double-array tries, one for each range of sequences.

Distinct sequences of turns are sorted and cut into ranges, the shards. A shard's turns get dense numbers, and its trie is
packed into BASE and CHECK arrays (Aoe, 1989): the child of state s by turn c is state BASE[s] + c if CHECK there is s.
Walking all sequences of the shard through them at once gives each node's members. As shards are ranges, a node can lie in
two of them only if it is a prefix of a shard's first or last sequence. Those spines stay open; runs of neighbouring
shards merge theirs, which closes all but the outer ones, until one run is left. A hot first turn, or a hot prefix of
any length, is thus cut like any other part of the order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigo.llm.common import frugal, whole_groups
from vestigo.sources.tables import written

#: Turns of a shard, of which a task holds all; neighbouring shards whose spines merge in one task; ids hashed as one piece.
SHARD_TURNS, RUN, PIECE = 200_000, 64, 1000
#: Bytes of a turn in a sequence: MD5 of role and text, and the text's length.
TURN = 24
#: For a node with several children, the free places tried before it goes behind all others, and the stretch they are sought in.
TRIES, WINDOW = 64, 1024
NODES = ("shard long, open boolean, side int, own binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved long, size long, ends string")
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in NODES.split(", "))])
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_code(role: Column, text: Column) -> Column:
    """TURN bytes that stand for a turn: equal for equal role and text only."""
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.unhex(F.md5(told)), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's codes in the order of ``k``, end to end.

    ``rows`` has (conv_id, k, code); a row with a null code adds no turn, so a conversation without turns has one.
    """
    def work(batches):
        now, codes = None, []
        for batch in batches:
            ids, found = [], []
            for conv, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if conv != now:
                    if now is not None:
                        ids.append(now)
                        found.append(b"".join(codes))
                    now, codes = conv, []
                if code is not None:
                    codes.append(code)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["conv_id", "turns"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(codes)], pa.binary())], ["conv_id", "turns"])

    return whole_groups(rows, ["conv_id"], ["k"]).select("conv_id", "code").mapInArrow(frugal(work), "conv_id long, turns binary")


def ids_digests(rows: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of each key's ids in ascending order, joined by commas.

    Ids are joined to pieces of up to PIECE where they lie, in tasks that a common key is spread over; the digest of
    a key then takes its pieces in order, one after the other, and holds none of them.
    """
    def pieces(batches):
        key, ids = None, []
        for batch in batches:
            out = []
            for now, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now != key or len(ids) == PIECE:
                    if ids:
                        out.append((key, ids[0], ",".join(map(str, ids))))
                    key, ids = now, []
                ids.append(conv)
            yield _rows(out, ("key", "least", "ids"), (pa.binary(), pa.int64(), pa.string()))
        if ids:
            yield _rows([(key, ids[0], ",".join(map(str, ids)))], ("key", "least", "ids"), (pa.binary(), pa.int64(), pa.string()))

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for now, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if now != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield _rows(out, ("key", "ends"), (pa.binary(), pa.string()))
        if state is not None:
            yield _rows([(key, state.hexdigest())], ("key", "ends"), (pa.binary(), pa.string()))

    spread = rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    cut = spread.mapInArrow(frugal(pieces), "key binary, least long, ids string")
    return whole_groups(cut, ["key"], ["least"]).mapInArrow(frugal(hashed), "key binary, ends string")


def _rows(rows, names, kinds):
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], list(names))


class DoubleArray:
    """BASE and CHECK with state 0 as the root; a state is a node of the trie."""

    def __init__(self, room: int):
        self.base, self.check = np.zeros(room, np.int64), np.full(room, -1, np.int64)
        self.check[0] = 0
        self.low, self.high = 1, 1  # no place below low is free, all from high on are

    def grow(self, room: int) -> None:
        more = max(room, 2 * len(self.check)) - len(self.check)
        self.base, self.check = np.r_[self.base, np.zeros(more, np.int64)], np.r_[self.check, np.full(more, -1, np.int64)]

    def free(self, count: int) -> np.ndarray:
        """The first ``count`` free places."""
        if self.high + count > len(self.check):
            self.grow(self.high + count)
        places = self.low + np.flatnonzero(self.check[self.low:self.high + count] < 0)[:count]
        return places

    def add_level(self, states: np.ndarray, codes: np.ndarray) -> None:
        """Children of new parents: pairs grouped by state, codes ascending in each."""
        starts = np.flatnonzero(np.r_[True, states[1:] != states[:-1]])
        sizes = np.diff(np.r_[starts, len(states)])
        for at, n in zip(starts[sizes > 1], sizes[sizes > 1]):  # nodes with several children first, they fit less easily
            few = codes[at:at + n]
            base = self._fit(few)
            self.base[states[at]], self.check[base + few] = base, states[at]
            self.high = max(self.high, int(base + few[-1]) + 1)
        one = starts[sizes == 1]
        places = self.free(len(one))
        self.base[states[one]], self.check[places] = places - codes[one], states[one]
        if len(places):
            self.high = max(self.high, int(places[-1]) + 1)
            self.low = int(places[-1]) + 1

    def _fit(self, codes: np.ndarray) -> int:
        width = int(codes[-1] - codes[0]) + 1
        near = self.low + np.flatnonzero(self.check[self.low:min(self.low + WINDOW, self.high)] < 0)
        if not len(near) and self.low + WINDOW < self.high:
            self.low += WINDOW
        for place in near[:TRIES]:
            if place + width > len(self.check):
                self.grow(place + width)
            if (self.check[place - codes[0] + codes] < 0).all():
                return int(place - codes[0])
        if self.high + width > len(self.check):
            self.grow(self.high + width)
        return int(self.high - codes[0])

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states that the codes lead to."""
        found = self.base[states] + codes
        if not (self.check[found] == states).all():
            raise AssertionError("a sequence left the trie it was built from")
        return found


def dense_codes(turns: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes 0, 1, ... of all turns, in the order of depth and then of sequences, so that children of a node mostly follow
    each other; where each sequence begins among them; and each code's text length."""
    raw = np.frombuffer(b"".join(turns), np.uint8).reshape(-1, TURN)
    starts = np.r_[0, np.cumsum(lengths)]
    depth = np.arange(len(raw)) - np.repeat(starts[:-1], lengths)
    keys = np.ascontiguousarray(raw).view(">u8").astype(np.uint64).reshape(-1, 3)
    order = np.lexsort((np.arange(len(raw)), depth, keys[:, 1], keys[:, 0]))
    fresh = np.r_[True, (keys[order][1:, :2] != keys[order][:-1, :2]).any(axis=1)] if len(raw) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1  # by digest; the first of each group is its least (depth, sequence)
    first = order[fresh]
    rank = np.empty(len(first), np.int64)
    rank[np.lexsort((first, depth[first]))] = np.arange(len(first))
    codes = np.empty(len(raw), np.int64)
    codes[order] = rank[group]
    sizes = np.empty(len(first), np.int64)
    sizes[rank] = keys[first, 2].astype(np.int64)
    return codes, starts, sizes


def shard_nodes(shard: int, turns: list[bytes], counts: np.ndarray, least: np.ndarray, ends: list[str]) -> pa.RecordBatch | None:
    """Nodes of a range of distinct sequences in order, with the conversations of each: their number, least id, digest of ids."""
    if not turns:
        return None
    lengths = np.array([len(t) // TURN for t in turns])
    codes, starts, sizes = dense_codes(turns, lengths)
    trie = DoubleArray(len(codes) + len(sizes) + TRIES + 2)
    at = np.zeros(len(turns), np.int64)
    levels, stops = [np.zeros(1, np.int64)], np.zeros(len(turns), np.int64)
    size, fan = {}, {}
    for depth in range(int(lengths.max(initial=0))):
        live = np.flatnonzero(lengths > depth)
        states, here = at[live], codes[starts[live] + depth]
        new = np.flatnonzero(np.r_[True, (states[1:] != states[:-1]) | (here[1:] != here[:-1])])
        pairs = np.lexsort((here[new], states[new]))
        trie.add_level(states[new][pairs], here[new][pairs])
        at[live] = trie.step(states, here)
        stops[live] = at[live]
        levels.append(at[live[new]])
        size[depth + 1] = sizes[here[new]]
    room = len(trie.check)
    n, low, weight, children, leaves, saved = (np.zeros(room, np.int64) for _ in range(6))
    low[:] = np.iinfo(np.int64).max
    for depth, states in enumerate(levels[1:], 1):
        weight[states] = size[depth]
        np.add.at(children, trie.check[states], 1)
    np.add.at(n, stops, counts)
    np.minimum.at(low, stops, least)
    for states in reversed(levels[1:]):  # members end at a node or below it
        np.add.at(n, trie.check[states], n[states])
        np.minimum.at(low, trie.check[states], low[states])
    spines = [_spine(trie, turns[i], codes[starts[i]:starts[i] + lengths[i]]) for i in (0, -1 % len(turns))]
    side = np.zeros(room, np.int64)
    own = {}
    for bit, spine in zip((1, 2), spines):
        for state, key, _ in spine:
            side[state] |= bit
        own |= {state: (key, above) for state, key, above in spine}
    for depth in range(len(levels) - 1, 0, -1):
        states = levels[depth]
        leaves[states[(children[states] == 0) & (side[states] == 0)]] = 1
        closed = states[side[states] == 0]
        saved[closed] += (n[closed] - 1) * weight[closed]
        np.add.at(leaves, trie.check[closed], leaves[closed])
        np.add.at(saved, trie.check[closed], saved[closed])
        np.subtract.at(children, trie.check[states[side[states] > 0]], 1)  # open children are counted when they are closed
    found = np.concatenate(levels)
    depths = np.repeat(np.arange(len(levels)), [len(s) for s in levels])
    digest = dict(zip(stops.tolist(), ends))
    parents, is_open = trie.check[found], side[found] > 0
    above_open = side[parents] > 0
    listed = found.tolist()
    columns = [
        pa.array(np.full(len(found), shard)), pa.array(is_open), pa.array(side[found].astype(np.int32)),
        pa.array([own[s][0] if s in own else None for s in listed], pa.binary()),
        pa.array([own[s][1] if s in own else own[p][0] if p in own else None for s, p in zip(listed, parents.tolist())], pa.binary()),
        pa.array(depths), pa.array(low[found]), pa.array(low[parents], mask=above_open), pa.array(n[found]), pa.array(children[found]),
        pa.array(leaves[found]), pa.array(saved[found]), pa.array(weight[found]), pa.array([digest.get(s) for s in listed], pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


def _spine(trie: DoubleArray, turns: bytes, codes: np.ndarray) -> list[tuple[int, bytes, bytes | None]]:
    """(state, key, parent's key) along a sequence; keys are chained digests, equal in all shards."""
    state, key = 0, b""
    found = [(0, b"root", None)]
    for i, code in enumerate(codes.tolist()):
        state = int(trie.base[state]) + code
        key = hashlib.blake2b(key + turns[i * TURN:(i + 1) * TURN], digest_size=16).digest()
        found.append((state, key, found[-1][1]))
    return found


def merged_run(rows: list[dict], last: bool, run: int = RUN) -> list[dict]:
    """Open nodes of neighbouring shards as one run: nodes that no other run can hold are closed, all of them at the last."""
    ends = min(r["shard"] for r in rows) // run, min(r["shard"] for r in rows), max(r["shard"] for r in rows)
    nodes: dict[bytes, dict] = {}
    for r in rows:
        side = 0 if last else (r["side"] & 1) * (r["shard"] == ends[1]) | (r["side"] & 2) * (r["shard"] == ends[2])
        node = nodes.get(r["own"])
        if node is None:
            nodes[r["own"]] = r | {"shard": ends[0], "side": side}
            continue
        for name in ("n_convs", "n_children", "n_leaves", "saved"):
            node[name] += r[name]
        node["conv_id"], node["side"] = min(node["conv_id"], r["conv_id"]), node["side"] | side
        node["ends"] = node["ends"] or r["ends"]
    for node in sorted(nodes.values(), key=lambda x: -x["depth"]):
        node["open"] = node["side"] > 0
        if node["open"]:
            continue
        node["n_leaves"] += node["n_children"] == 0
        node["saved"] += (node["n_convs"] - 1) * node["size"]
        above = nodes.get(node["parent"])
        if above is not None:
            above["n_children"] += 1
            above["n_leaves"] += node["n_leaves"]
            above["saved"] += node["saved"]
    return list(nodes.values())


def _merge(nodes: DataFrame, last: bool, run: int) -> DataFrame:
    def work(batches):
        at, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                now = r.pop("run")
                if now != at and rows:
                    yield pa.RecordBatch.from_pylist(merged_run(rows, last, run), SCHEMA)
                    rows = []
                at = now
                rows.append(r)
        if rows:
            yield pa.RecordBatch.from_pylist(merged_run(rows, last, run), SCHEMA)

    return whole_groups(nodes.withColumn("run", F.floor(F.col("shard") / run)), ["run"], ["shard"]).mapInArrow(frugal(work), NODES)


def prefix_nodes(rows: DataFrame, shard_turns: int = SHARD_TURNS, run: int = RUN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, ends) of each node of the conversations' trie.

    ``rows`` has (conv_id, k, code): turns in the order of ``k`` with codes of ``turn_code``, and a row without a code for
    a conversation that may have no turn. A node is a distinct beginning of a conversation; its members begin with it.
    ``conv_id`` is the least member, ``ends`` the digest of the ids of members that end there (of the empty string when
    there is none), ``saved`` sums (members - 1) times the last turn's text length over the node and all below it. Equal
    conversations share all nodes. An empty table has no root. Conversations without an id are left out. A conversation's
    codes are held as one value, 24 bytes a turn.
    """
    spark = rows.sparkSession
    told = written(sequences(rows.filter("conv_id is not null").select("conv_id", "k", "code")).withColumn(
        "key", F.unhex(F.md5("turns"))), "sequences")
    ends = ids_digests(told)
    distinct = told.groupBy("key").agg(F.first("turns").alias("turns"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    whole = written(distinct.join(ends, "key").drop("key"), "distinct")
    turns = whole.agg(F.coalesce(F.sum(F.octet_length("turns")), F.lit(0))).first()[0] // TURN
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))

    def shard(batches):
        held = [[], [], [], []]
        for batch in batches:
            for column, more in zip(held, batch.columns):
                column.extend(more.to_pylist())
        nodes = shard_nodes(TaskContext.get().partitionId(), held[0], np.array(held[1], np.int64), np.array(held[2], np.int64), held[3])
        if nodes is not None:
            yield nodes

    found = written(whole.select("turns", "n", "least", "ends").repartitionByRange(parts, "turns").sortWithinPartitions("turns")
                    .mapInArrow(frugal(shard), NODES), "nodes")
    open_nodes, shards, closed = found.filter("open"), found.agg(F.max("shard")).first()[0] or 0, []
    while True:
        now = written(_merge(open_nodes, shards < run, run), "merged")
        closed.append(now.filter("not open"))
        if shards < run:
            break
        open_nodes, shards = now.filter("open"), shards // run
    late = closed[0]
    for more in closed[1:]:
        late = late.unionByName(more)
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends", F.lit(NOTHING)).alias("ends")]
    done = found.filter("not open")
    waiting = done.filter("parent is not null").unionByName(late)
    keys = late.select(F.col("own").alias("k"), F.col("conv_id").alias("above"))
    named = waiting.join(keys, F.col("parent") == F.col("k"), "left").withColumn("parent_conv_id", F.col("above"))
    return done.filter("parent is null").select(*shown).unionByName(named.select(*shown))
