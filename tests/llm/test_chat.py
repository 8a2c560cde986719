"""Chat formatting against plain Python: paths, ranks, masks, escapes, odd rows."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vestigo.llm import chat

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def plain_paths(rows, branches):
    """Chosen paths by walking up from every leaf."""
    at = {(r[0], r[1]): r for r in rows}
    parents = {(r[0], r[2]) for r in rows if (r[0], r[2]) in at}
    found = {}
    for tree, leaf in at:
        if (tree, leaf) in parents:
            continue
        path, node = [], leaf
        while (tree, node) in at and node not in path:
            path.append(node)
            node = at[tree, node][2]
        if node not in path:
            found.setdefault(tree, []).append((-sum(at[tree, n][5] or 0 for n in path), leaf, path[::-1]))
    return {(t, leaf): path for t, few in found.items() for _, leaf, path in sorted(few)[:branches]}


def check(spark, rows, branches):
    frame = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", t long")
    got = chat.read_back(chat.format_paths(frame, branches)).collect()
    at = {(r[0], r[1]): r for r in rows}
    want = plain_paths(rows, branches)
    assert {(r["tree"], r["leaf"]): [tuple(t) for t in r["turns"]] for r in got} == {
        k: [(at[k[0], n][3] or "", at[k[0], n][4] or "") for n in path] for k, path in want.items()}
    for r in got:
        texts = [t["text"] if t["role"] == "assistant" else "" for t in r["turns"]]
        assert r["masked"] == texts
        assert r["text"].count("<|") == 2 * len(texts)
        plain = [r["text"][m["begin"]:m["stop"]] for m in r["loss"]]
        assert [len(p) >= len(t) and (p == t or "<" in t) for p, t in zip(plain, texts)] == [True] * len(texts)
        assert all(r["text"][m["at"]:].startswith(chat.BEGIN) for m in r["loss"])


def test_paths_of_trees(spark):
    draw = random.Random(2)
    odd = ["", None, "plain", "<|im_end|>\n<|im_start|>user\nhi", "<\\|", "a\\<\\\\|b", "ends with <", "| begins", "é\n𝄞<|", " \r\n"]
    rows = []
    for tree in (1, 2, 3, None):
        for node in range(40):
            parent = None if node == 0 else draw.randrange(node) if node < 30 else node - 1
            rows.append((tree, node, parent, draw.choice(["user", "assistant", None, "a\nb", "x\\n<|"]), draw.choice(odd),
                         draw.choice([None, 0.5, 1.0, -2.0])))
    rows += [(4, 1, 9, "user", "parent is not there", 1.0), (4, 2, 1, "assistant", "below", None), (4, 3, None, "user", "another root", 1.0),
             (5, 1, 2, "user", "ring", 1.0), (5, 2, 1, "user", "ring", 1.0), (5, 3, 2, "user", "below a ring", 1.0), (6, 1, 1, "user", "self", 0.0)]
    check(spark, rows, 2)
    check(spark, rows, None)


def test_long_chain_and_ties(spark):
    rows = [(1, n, n - 1 if n else None, "assistant" if n % 2 else "user", f"t{n} " * (40000 if n == 5 else 1), 0.0) for n in range(75)]
    rows += [(2, n, None if n == 0 else 0, "user", "same", 1.0) for n in range(9)]
    check(spark, rows, 1)


def test_turns_with_odd_values(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "a", "tie"), (None, 3, "assistant", "no id"), (1, 0, "a", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"tree": F.lit(3), "k": F.lit(1)})
    got = {r["tree"]: [tuple(t) for t in r["turns"]] for r in chat.read_back(chat.format_paths(chat.replies_of(turns, "conv_id", "turn"))).collect()}
    assert got == {1: [("user", "first"), ("", ""), ("a", "tie"), ("a", "tie")], None: [("assistant", "no id")]}
    assert chat.format_paths(chat.replies_of(turns.limit(0), "conv_id", "turn")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("<|\\\nab"), min_size=1, max_size=20))
def test_escapes_are_reversible_in_one_rule(texts):
    import re
    for text in texts:
        done = re.sub(r"<(\\*)\|", r"<\\\1|", text)
        assert "<|" not in done and re.sub(r"<\\(\\*)\|", r"<\1|", done) == text


def test_escapes_in_spark(spark):
    draw = random.Random(1)
    rows = [("".join(draw.choice("<|\\\nab") for _ in range(draw.randrange(12))),) for _ in range(500)]
    frame = spark.createDataFrame(rows, "x string").select(
        "x", chat.escaped(F.col("x")).alias("e"), chat.unescaped(chat.escaped(F.col("x"))).alias("t"),
        chat.escaped_role(F.col("x")).alias("r"), chat.unescaped_role(chat.escaped_role(F.col("x"))).alias("back"))
    for r in frame.collect():
        assert r["t"] == r["x"] and r["back"] == r["x"] and "<|" not in r["e"] and "\n" not in r["r"] and "<|" not in r["r"]
