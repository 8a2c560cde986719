"""Conversation structure repair by a suffix-shared automaton of role and fault signatures.

A conversation is reduced to a word with one letter a turn: the role's class, and whether the turn must go or is cut
short. What a repair costs from a turn on depends on the rest of the word and the state of the role grammar only. So
distinct words are shared from their ends: sorted by their reversed letters, a word adds nodes only for the part that its
neighbour does not end in, and each node holds, for each grammar state, the cost to go and the first edit of the best
rest. Nodes whose costs differ by a constant decide alike, so those decisions are made once and remembered.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigo.llm.common import frugal, whole_groups
from vestigo.sources.tables import written

#: Grammar (s?(ua)+)?: states 0 nothing yet, 1 after s, 2 after u, 3 after a. Roles that lead on, and the role to insert.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
DELETE, INSERT, REROLE, CUT_SHORT = 4, 3, 3, 3
BLANKS = r"\x20\x09-\x0D"
END = ((0, ""), (2 * INSERT, "I"), (INSERT, "I"), (0, ""))
SIGNED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, word string"


def turn_rows(turns: DataFrame, id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id, turn, role, text): other columns are dropped, so that their names cannot clash; null roles and texts are empty."""
    return turns.select(F.col(id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_digest() -> Column:
    return F.unhex(F.md5(F.col("text")))


def signatures(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, word) of each conversation, from the output of ``turn_rows``.

    Turns are ordered by number (null first), turns of one number by role and MD5 of the text. A turn's first fault
    counts: blank (no character but blanks), duplicate (role and text occur earlier in the conversation), truncated
    (last such character is none of ``.!?``). ``gaps`` are missing numbers between the least and the largest; ``illegal``
    counts neighbours whose role initials are not su, ua or au. Rows without an id are one conversation. Only digests
    of texts are shuffled.
    """
    last = F.regexp_extract("text", rf"([^{BLANKS}])[{BLANKS}]*\z", 1)
    rows = turns.select("conv_id", "turn", "role", text_digest().alias("digest"), F.when(last == "", "b").when(~last.isin(*".!?"), "t")
                        .otherwise("").alias("fault"))
    # the number of one turn's equal rows takes their place: all copies but the earliest are duplicates
    copies = rows.groupBy("conv_id", "role", "digest", "turn", "fault").agg(F.count(F.lit(1)).alias("n"))
    first = F.expr("row_number() over (partition by conv_id, role, digest order by turn nulls first) = 1").alias("first")
    placed = copies.select("conv_id", "turn", "role", "digest", "fault", "n", first)
    return whole_groups(placed, ["conv_id"], ["turn", "role", "digest"]).mapInArrow(frugal(_signed), SIGNED)


def _signed(batches):
    """One row a conversation from its turns in order; a conversation may lie in several batches."""
    done, now = [], None

    def close():
        conv, low, high, distinct, counts, word, _, _ = now
        done.append((conv, high - low + 1 - distinct if low is not None else 0, counts["b"], counts["d"], counts["t"], counts["i"], "".join(word)))

    for batch in batches:
        for conv, turn, role, fault, n, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "fault", "n", "first"))):
            if now is None or now[0] != conv:
                if now is not None:
                    close()
                now = [conv, None, None, 0, dict.fromkeys("bdti", 0), [], None, None]
            counts, word = now[4], now[5]
            if turn is not None:
                now[1] = turn if now[1] is None else now[1]
                now[3] += now[2] != turn
                now[2] = turn
            initial = role[:1]
            if now[6] is not None:
                counts["i"] += now[6] + initial not in LEGAL
            counts["i"] += (n - 1) * (initial + initial not in LEGAL)
            now[6] = initial
            letter = initial if initial in ("s", "u", "a") else "o"
            kept = fault != "b" and first
            if fault == "b":
                counts["b"] += n
            else:
                counts["d"] += n - first
                counts["t"] += kept and fault == "t"
            word.append((letter.upper() if fault else letter) + "x" * (n - 1) if kept else "x" * n)
        if done:
            yield _batch(done)
            done = []
    if now is not None:
        close()
        yield _batch(done)


def _batch(rows):
    names = [x.split()[0] for x in SIGNED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if name == "word" else pa.int64()) for name, c in zip(names, zip(*rows))], names)


def decisions(letter: str, costs: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Costs to go of a turn before a rest of ``costs``, and for each grammar state the edit and the state after it.

    Of the cheapest edits the one with the least initial is taken. Edits of one state have different initials, so this
    gives the least audit among the cheapest ones.
    """
    options = []
    for state in range(4):
        found = {"D": (DELETE + costs[state], state)}
        if letter != "x":
            extra, to = CUT_SHORT if letter.isupper() else 0, STEPS[state][WANTED[state]]
            found["R"] = (REROLE + extra + costs[to], to)
            if (kept := STEPS[state].get(letter.lower())) is not None:
                found["K"] = (extra + costs[kept], kept)
        options.append(found)
    best = [min(c for c, _ in found.values()) for found in options]
    for _ in range(2):  # two inserted turns lead through every state that insertion reaches
        best = [min(best[s], INSERT + best[STEPS[s][WANTED[s]]]) for s in range(4)]
    edits = []
    for state, found in enumerate(options):
        to = STEPS[state][WANTED[state]]
        found["I"] = (INSERT + best[to], to)
        edits.append(min((edit, after) for edit, (cost, after) in found.items() if cost == best[state]))
    return tuple(best), tuple(edits)


def best_audits(batches):
    """(word, cost, audit) of words sorted by their reversed letters; the stack holds the nodes of the word at hand."""
    known: dict = {}
    end = (tuple(c for c, _ in END), tuple((edit, STEPS[s][WANTED[s]]) for s, (_, edit) in enumerate(END)))
    nodes, letters = [end], []
    for batch in batches:
        words, costs, audits = batch.column(0).to_pylist(), [], []
        for word in words:
            back = word[::-1]
            shared = 0
            while shared < min(len(back), len(letters)) and letters[shared] == back[shared]:
                shared += 1
            del nodes[shared + 1:], letters[shared:]
            for letter in back[shared:]:
                rest = nodes[-1][0]
                least = min(rest)
                key = letter, tuple(c - least for c in rest)
                if key not in known:
                    known[key] = decisions(*key)
                costs_here, edits = known[key]
                nodes.append((tuple(c + least for c in costs_here), edits))
                letters.append(letter)
            at, state, audit = len(word), 0, []
            while True:
                edit, after = nodes[at][1][state]
                if not edit:
                    break
                audit.append(edit)
                at, state = at - (edit != "I"), after
            costs.append(nodes[-1][0][0])
            audits.append("".join(audit))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["word", "cost", "audit"])


def solved(words: DataFrame) -> DataFrame:
    """(word, cost, audit) of distinct words: each range of reversed words is one task, so that shared ends are solved once in it."""
    back = F.reverse("word")
    return words.select("word").distinct().repartitionByRange(back).sortWithinPartitions(back).mapInArrow(
        frugal(best_audits), "word string, cost long, audit string")


def repairs(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation with turns.

    ``turns`` is the output of ``turn_rows``. The audit names the cheapest edits in order: Keep (0), Rerole to user or assistant
    (3), Delete (4; the only one for blank and duplicate turns), Insert a user or assistant turn without text (3);
    a truncated turn that stays adds 3. The roles' initials then match ``(s?(ua)+)?``. Of audits that cost the same
    the least one is given. An empty table gives no rows; all blank turns are deleted.
    """
    signed = written(signatures(turns), "signed")
    return signed.join(solved(signed), "word").drop("word")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the turns that ``found``'s audits leave, each conversation's rows next to each other.

    Turns and audits of a conversation meet as rows, so that a long audit is not repeated for each of its turns.
    """
    rows = turns.select("conv_id", F.lit(1).alias("kind"), "turn", "role", text_digest().alias("digest"), "text")
    audits = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                          F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    return whole_groups(rows.unionByName(audits), ["conv_id"], ["kind", "turn", "role", "digest"]).select(
        "conv_id", "kind", "role", "text").mapInArrow(frugal(_edited), "conv_id long, at long, role string, text string")


def _edited(batches):
    conv, audit, at, made, state = None, "", 0, 0, 0
    out: list[tuple] = []

    def inserted():
        nonlocal at, made, state
        while at < len(audit) and audit[at] == "I":
            out.append((conv, made, NAMES[WANTED[state]], ""))
            at, made, state = at + 1, made + 1, STEPS[state][WANTED[state]]

    def flush():
        columns = list(zip(*out)) if out else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["conv_id", "at", "role", "text"])

    for batch in batches:
        for now, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                inserted()
                conv, audit, at, made, state = now, text, 0, 0, 0
                continue
            inserted()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            initial = role[:1] if edit == "K" else WANTED[state]
            out.append((conv, made, role if edit == "K" else NAMES[initial], text))
            made, state = made + 1, STEPS[state][initial]
        yield flush()
        out = []
    inserted()
    yield flush()


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, digest): SHA-256 of ``role:text`` joined by line ends, for rows that lie as ``repaired`` gives them."""
    return rows.mapInArrow(frugal(_digests), "conv_id long, digest string")


def _digests(batches):
    conv, state = None, None
    for batch in batches:
        ids, found = [], []
        for now, at, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if at == 0:
                if state is not None:
                    ids.append(conv)
                    found.append(state.hexdigest())
                conv, state = now, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["conv_id", "digest"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "digest"])
