"""Conversation repair against a plain search over edits."""

import hashlib
import heapq
import random

from vestigo.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
STRIP = " \t\n\v\f\r"


def plain_faults(rows):
    """(rows in order with their fault, gaps, illegal) of one conversation."""
    rows = sorted(((t, r or "", x or "") for t, r, x in rows),
                  key=lambda w: (w[0] is not None, w[0] or 0, w[1], hashlib.md5(w[2].encode()).digest()))
    seen, found = set(), []
    for _, role, text in rows:
        fault = "blank" if not text.strip(STRIP) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(STRIP)[-1] not in ".!?" else ""
        seen.add((role, text))
        found.append((role, text, fault))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
    return found, gaps, illegal


def plain_repair(rows):
    """Cheapest edits by search: states are turns done and the last role kept."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, last, out = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (at, last) in done:
            continue
        done.add((at, last))
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        new = allowed[-1]
        name = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(heap, (cost + 3, audit + "I", at, new, (*out, (name, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, new, (*out, (name, text))))
                if role[:1] and role[:1] in allowed:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[0], (*out, (role, text))))


def check(spark, rows):
    turns = repair.turn_rows(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", word string, kind int"))
    found = repair.repairs(turns)
    got = {r["conv_id"]: r for r in found.collect()}
    texts = {r["conv_id"]: r["digest"] for r in repair.digests(repair.repaired(turns, found)).collect()}
    by_conv = {}
    for conv, *row in rows:
        by_conv.setdefault(conv, []).append(row)
    assert set(got) == set(by_conv)
    for conv, few in by_conv.items():
        faults, gaps, illegal = plain_faults(few)
        cost, audit, out = plain_repair(faults)
        counts = [sum(f == kind for _, _, f in faults) for kind in ("blank", "duplicate", "truncated")]
        r = got[conv]
        assert [r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]] == [gaps, *counts, illegal, cost, audit]
        want = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest() if out else None
        assert texts.get(conv) == want


def test_random_conversations(spark):
    draw = random.Random(7)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "Us"]
    texts = ["Yes.", "no", "", None, " \t\n", "Why?  ", "a b!\v", "…", "x. y", " "]
    rows = [(c, draw.choice([None, *range(9)]), draw.choice(roles), draw.choice(texts)) for c in range(300) for _ in range(draw.randrange(1, 9))]
    rows += [(None, 3, "user", "No id."), (None, 3, "user", "No id."), (-5, 2 ** 40, "assistant", "Far." * 50_000), (-5, 0, "user", "Near.")]
    rows += [(999, t, "user" if t % 3 else "assistant", f"{t // 2}.") for t in range(300)]
    check(spark, rows)


def test_shared_ends_over_batches():
    import pyarrow as pa
    draw = random.Random(3)
    words = sorted({"".join(draw.choice("sSuUaAoOx") for _ in range(draw.randrange(10))) for _ in range(400)} | {""}, key=lambda w: w[::-1])
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(words[i:i + size])], ["word"]) for i in range(0, len(words), size)]
        got = [tuple(r.values()) for b in repair.best_audits(batches) for r in b.to_pylist()]
        assert [w for w, _, _ in got] == words
        for word, cost, audit in got:
            rows = [(roles[x.lower()], str(i), "blank" if x == "x" else "truncated" if x.isupper() else "") for i, x in enumerate(word)]
            assert plain_repair(rows)[:2] == (cost, audit)


def test_no_turns(spark):
    turns = repair.turn_rows(spark.createDataFrame([], SCHEMA))
    found = repair.repairs(turns)
    assert found.count() == 0 and repair.digests(repair.repaired(turns, found)).count() == 0
