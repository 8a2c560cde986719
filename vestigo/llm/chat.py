"""Chat formatting: reply trees to root-to-leaf paths, each chosen path as one conversation with a loss mask.

Paths are found by iterative self-joins that double their reach: after round i every message knows its ancestor 2^i
replies up, so a tree of depth d takes about log2(d) rounds of joins on keys alone. Texts move twice: to their path's
keys, and to their path. All work is DataFrame functions.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles ``<|`` becomes ``<\\|`` (and ``<\\|``
becomes ``<\\\\|``, and so on), so that ``<|`` stands only where the template put it, and the way back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vestigo.sources.tables import written

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
KEYS = ["tree", "node"]


def escaped(text: Column) -> Column:
    """A text without ``<|``, from which ``unescaped`` gives it back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    """A role on one line: line ends and backslashes are written with a backslash."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def replies_of(turns: DataFrame, tree: str, turn: str) -> DataFrame:
    """(tree, node, parent, role, text, score): conversations as trees in which each turn answers the one before.

    Turns are ordered by number, null first; turns of one number by role and text. Null roles and texts are empty.
    Rows without a conversation id are one conversation, whose id stays null.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    at = F.row_number().over(Window.partitionBy(tree).orderBy(F.col(turn).asc_nulls_first(), role, text)).cast("long")
    return turns.select(F.col(tree).alias("tree"), at.alias("node"), role.alias("role"), text.alias("text")).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def jumps(links: DataFrame) -> list[DataFrame]:
    """Tables (tree, node, up, ups, total): for i = 0, 1, ... the ancestor ``up`` that is 2^i replies above ``node``.

    ``links`` has (tree, node, parent, score); ``total`` adds the scores of the 2^i messages from ``node`` up. Each round is
    written, so that none is computed again. A message above itself, in a ring of replies, would never end the
    rounds: they end when their reach exceeds the number of messages.
    """
    most = links.count()
    here = links.filter("parent is not null").select(*KEYS, F.col("parent").alias("up"), F.col("score").alias("total"))
    found, reach = [], 1
    while reach <= most:
        here = written(here, "jumps")
        if here.isEmpty():
            break
        found.append(here)
        above = here.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("u"), F.col("total").alias("more"))
        here = here.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select(
            *KEYS, F.col("u").alias("up"), (F.col("total") + F.col("more")).alias("total"))
        reach *= 2
    return found


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, node, back): the messages of the chosen root-to-leaf paths, ``back`` replies above their leaf.

    ``messages`` has (tree, node, parent, score). A message whose parent is not there begins a path of its own; one in
    a ring of replies, or below one, has no path. Branches of a tree are ranked by the sum of their messages' scores
    (null counts 0), equal sums by their leaf's number; the best ``branches`` are chosen, all of them when it is None.
    """
    links = messages.select(*KEYS, "parent", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    known = links.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    whole = links.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left").select(
        *KEYS, F.col("n").alias("parent"), "score")
    whole = written(whole, "links")
    tables = jumps(whole)
    parents = whole.filter("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()
    at = whole.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"), F.lit(0.0).alias("sum"))
    top = at
    for i in reversed(range(len(tables))):  # up to the root by the longest jumps that lead to a message
        top = top.join(_above(tables[i]), _meets(), "left").select(
            "tree", "leaf", F.coalesce("u", "node").alias("node"), (F.col("back") + F.when(F.col("u").isNotNull(), 1 << i).otherwise(0)).alias("back"),
            (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"))
    root = whole.filter("parent is null").select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("score").alias("last"))
    ranked = top.join(root, _meets()).select("tree", "leaf", (F.col("sum") + F.col("last")).alias("sum"))
    if branches is not None:
        order = Window.partitionBy("tree").orderBy(F.col("sum").desc(), "leaf")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= branches)
    rows = ranked.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back"))
    for i in reversed(range(len(tables))):  # all stops between, from the widest steps to the narrowest
        wide = rows.join(_above(tables[i]), _meets()).select("tree", "leaf", F.col("u").alias("node"), (F.col("back") + (1 << i)).alias("back"))
        rows = rows.unionByName(wide)
        if i:
            rows = written(rows, "stops")
    return rows


def _above(table: DataFrame) -> DataFrame:
    return table.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("u"), F.col("total").alias("more"))


def _meets() -> Column:
    return F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))


def format_paths(messages: DataFrame, branches: int | None = 1, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(tree, leaf, text, loss): each chosen path as one conversation in the template, with its loss mask.

    ``messages`` has (tree, node, parent, role, text, score), unique by (tree, node); other columns are ignored. ``loss``
    has an entry for each turn: ``at``, where the turn begins in ``text``, and ``begin`` and ``stop`` of its part under
    the mask, all in code points; ``begin`` equals ``stop`` where nothing is trained. Only texts of ``trained`` roles
    are under the mask. Null roles and texts are empty. An empty table gives no rows. One conversation is one row, so
    it has to stay below Spark's 2 GB a value.
    """
    role, body = F.coalesce(F.col("role"), F.lit("")), escaped(F.coalesce(F.col("text"), F.lit("")))
    head = F.concat(F.lit(BEGIN), escaped_role(role), F.lit("\n"))
    pieces = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), head.alias("head"), body.alias("body"),
                             role.isin(*trained).alias("trained"))
    order = Window.partitionBy("tree", "leaf").orderBy("k")
    turns = paths(messages, branches).join(pieces, _meets()).select(
        "tree", "leaf", (-F.col("back")).alias("k"), F.concat("head", "body", F.lit(END)).alias("turn"),
        F.length("head").cast("long").alias("begin"), F.when(F.col("trained"), F.length("body")).otherwise(0).cast("long").alias("size"))
    at = F.sum(F.length("turn")).over(order) - F.length("turn")
    placed = turns.withColumn("at", at.cast("long")).select("tree", "leaf", F.struct(
        "k", "turn", "at", (F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("begin") + F.col("size")).alias("stop")).alias("turn"))
    done = placed.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return done.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("text"),
                       F.transform("turns", lambda t: F.struct(t["at"].alias("at"), t["begin"].alias("begin"), t["stop"].alias("stop"))).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns``, an array of (role, text) read from its text alone, and ``masked``, the texts under its loss mask."""
    pieces = F.filter(F.split("text", r"<\|im_end\|>\n"), lambda x: x != "")
    role = lambda x: unescaped_role(F.substring_index(F.substr(x, F.lit(len(BEGIN) + 1)), "\n", 1))
    text = lambda x: unescaped(F.substr(x, F.locate("\n", x) + 1))
    masked = F.zip_with(pieces, F.col("loss"), lambda x, m: F.when(
        m["stop"] > m["begin"], unescaped(F.substr(x, (m["begin"] - m["at"] + 1).cast("int"), (m["stop"] - m["begin"]).cast("int")))).otherwise(""))
    return formatted.withColumns({"turns": F.transform(pieces, lambda x: F.struct(role(x).alias("role"), text(x).alias("text"))), "masked": masked})
