"""The prefix trie against plain Python: several shards, runs of shards, odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vestigo.llm import prefix_trie


def plain_nodes(sequences):
    """The trie by listing all beginnings; a turn is (role, text)."""
    members = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(conv)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        yield node
        for child in children.get(node, []):
            yield from below(child)

    found = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if sequences[c] == node)))
        sub = list(below(node))
        found.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])),
                      sum(x not in children for x in sub), sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in sub if x),
                      hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def code(turn):
    role, text = turn
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest() + len(text.encode()).to_bytes(8, "big")


def sample(draw, n, kinds, depth):
    turns = [("user", "x" * i + "é" * (i % 2)) for i in range(kinds)]
    return {c: tuple(draw.choice(turns) for _ in range(draw.choice([0, 1, 2, draw.randrange(depth)]))) for c in range(n)}


@pytest.mark.parametrize("n, kinds, depth, shards, run", [
    (0, 1, 2, 1, 2), (1, 1, 2, 1, 2), (200, 2, 9, 1, 2), (200, 2, 9, 7, 2), (300, 3, 6, 40, 3), (300, 60, 4, 9, 2), (40, 1, 300, 9, 64), (500, 400, 3, 3, 2)])
def test_shards_and_runs(n, kinds, depth, shards, run):
    draw = random.Random(n + kinds)
    sequences = sample(draw, n, kinds, depth)
    distinct = {}
    for conv, turns in sequences.items():
        distinct.setdefault(b"".join(map(code, turns)), []).append(conv)
    rows = [(s, len(c), min(c), hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest()) for s, c in sorted(distinct.items())]
    cuts = sorted(draw.choices(range(len(rows) + 1), k=shards - 1))
    nodes = []
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        part = rows[a:b]
        batch = prefix_trie.shard_nodes(k, [r[0] for r in part], np.array([r[1] for r in part], np.int64),
                                        np.array([r[2] for r in part], np.int64), [r[3] for r in part])
        nodes += batch.to_pylist() if batch else []
    done, still, top = [r for r in nodes if not r["open"]], [r for r in nodes if r["open"]], shards - 1
    late = []
    while still:
        runs = {}
        for r in still:
            runs.setdefault(r["shard"] // run, []).append(r)
        now = [r for few in runs.values() for r in prefix_trie.merged_run(few, top < run, run)]
        late += [r for r in now if not r["open"]]
        still, top = [r for r in now if r["open"]], top // run
    above = {r["own"]: r["conv_id"] for r in late}
    assert len(above) == len(late)
    got = []
    for r in done + late:
        parent = r["parent_conv_id"] if r["parent"] is None and r["own"] is None else above.get(r["parent"])
        got.append((r["conv_id"], r["depth"], parent, r["n_convs"], r["n_children"], r["n_leaves"], r["saved"], r["ends"] or prefix_trie.NOTHING))
    assert sorted(got, key=repr) == plain_nodes(sequences)


def test_conversations_in_spark(spark):
    draw = random.Random(8)
    sequences = sample(draw, 120, 3, 7) | {1000 + c: (("user", "hot"), ("assistant", "")) for c in range(2500)} | {
        -7: (("user", "hot"), ("assistant", ""), ("user", "long " * 60_000)), 2 ** 40: (("", "hot"),)}
    rows = [(c, k, r, t, "x") for c, turns in sequences.items() for k, (r, t) in enumerate([*turns, (None, None)])]
    rows += [(None, 0, "user", "no id", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, k long, role string, text string, code_ string")
    turn = F.when(F.col("role").isNotNull(), prefix_trie.turn_code(F.col("role"), F.col("text")))
    frame = frame.withColumns({"code": turn, "turns": F.lit(1), "key": F.lit(2)})
    got = sorted(map(tuple, prefix_trie.prefix_nodes(frame, shard_turns=50, run=2).collect()), key=repr)
    assert got == plain_nodes(sequences)
    assert prefix_trie.prefix_nodes(frame.limit(0)).collect() == []


def test_rebuilt_conversations(spark):
    from vestigo.llm import queries
    import zlib
    draw = random.Random(5)
    rows = [(c, draw.choice([None, *range(6)]), draw.choice(["user", None, "assistant"]), draw.choice(["a", None, "", "b" * 9]))
            for c in [*range(-12, 40), 101, None] for _ in range(draw.randrange(1, 12)) if c not in (20, 21)]
    frame = spark.createDataFrame([(*r, 0, 1) for r in rows], "conv_id long, turn long, role string, text string, k int, h int")
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, code((role or "", text or ""))))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    want = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        lender = conv - int(np.fmod(conv, 5))
        want[conv] = b"".join(own.get(lender, [])[:h] + turns[h:])
    got = {r["conv_id"]: bytes(r["turns"]) for r in prefix_trie.sequences(queries.rebuilt(frame)).collect()}
    assert got == want
