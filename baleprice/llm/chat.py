"""Reply trees to chat text, with DataFrame functions only.

Messages form trees by ``parent_id``. Iterative self-joins double the reach of every message's ancestor pointer, so the
depth and the summed score of all root-to-leaf paths are known after as many joins as the depth has bits. Leaves rank
the branches by score; only chosen branches are expanded, again by doubling, and each becomes one conversation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baleprice.llm.common import written

# FIXED VALUES of the template: what opens a turn, what follows the role, what ends a turn, and the escapes of these
# control strings inside roles and texts. No escape holds a control string or, but at its start, a backslash.
OPEN = "### "
ROLE_END = ": "
CLOSE = "</turn>\n"
ESCAPES = (("\\", "\\b"), ("### ", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (": ", "\\c"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    for control, code in pairs:
        text = F.replace(text, F.lit(control), F.lit(code))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    """The reverse of ``escape``: in an escaped text every backslash starts a code, so none can be read twice."""
    for control, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(control))
    return text


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equality join by columns where null equals null; the columns of the left side stay."""
    names = [f"_right_{c}" for c in on]
    right = right.withColumnsRenamed(dict(zip(on, names)))
    return left.join(right, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(on, names)]), how).drop(*names)


def _reach(nodes: DataFrame, max_rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """Per message its depth and summed score from the root, and the jump tables (message, ancestor 2**k above)."""
    state = written(nodes.select("tree", "node", "nth", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"),
                                 "score"), "reach")
    jumps = []
    for _ in range(max_rounds):
        active = state.filter("up IS NOT NULL")
        if active.isEmpty():
            return state.select("tree", "node", "nth", "depth", "score"), jumps
        jumps.append(active.select("tree", "node", "nth", "up"))
        above = state.filter("node IS NOT NULL").select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"),
                             F.col("score").alias("_score"))
        moved = _join(active, above, ["tree", "up"]).select(
            "tree", "node", "nth", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"),
            (F.col("score") + F.col("_score")).alias("score"))
        state = written(moved.unionByName(state.filter("up IS NULL")), "reach")
    raise ValueError(f"a reply chain is longer than 2**{max_rounds} messages or is a circle")


def reply_paths(messages: DataFrame, top_k: int | None = 1, max_rounds: int = 24) -> DataFrame:
    """The chosen root-to-leaf paths: (tree, leaf, rank, turn, role, text, n_turns, path_score), a row per turn.

    ``messages`` has tree, node, parent (null at a root), role, text, score (null: 0). Branches of a tree are ranked
    by the mean score along the path, ties by the longer path, then by the smaller leaf; ``top_k`` branches are kept
    (None: all). A parent that isn't in its tree makes its child a root; nodes must be unique in their tree; a circle
    of replies raises ValueError; null texts and roles become empty. A null tree is a tree like any other, of all its
    messages. No reply can name a message whose node is null: it is a leaf, a null one in the result; any number of
    them in a tree are messages on their own, in a tie of rank after one another by parent, role, text and score, before
    other leaves. No rows in, no rows out. Other columns are ignored."""
    m = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"),
                        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    # numbers for the messages without a node, 0 for all others
    unnamed = m.filter("node IS NULL").withColumn("nth", F.row_number().over(
        Window.partitionBy("tree").orderBy("parent", "role", "text", "score")).cast("long"))
    m = m.filter("node IS NOT NULL").withColumn("nth", F.lit(0).cast("long")).unionByName(unnamed)
    links = m.select("tree", "node", "nth", "parent", "score")
    known = links.filter("node IS NOT NULL").select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    links = _join(links, known, ["tree", "parent"], "left").select(
        "tree", "node", "nth", F.when(F.col("_known"), F.col("parent")).alias("parent"), "score")
    links = written(links, "replies")
    reach, jumps = _reach(links, max_rounds)
    inner = links.filter("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = _join(reach, inner, ["tree", "node"], "left_anti").withColumn("path_score", F.col("score") / F.col("depth"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), F.desc("depth"), "node", "nth"))
    leaves = leaves.withColumn("rank", rank)
    if top_k is not None:
        leaves = leaves.filter(F.col("rank") <= top_k)
    paths = written(leaves, "leaves").select("tree", F.col("node").alias("leaf"), "rank", F.col("depth").alias("n_turns"), "path_score",
                          "node", "nth", F.lit(0).cast("long").alias("back"))
    for k, jump in enumerate(jumps):
        # written, or the plan would double with every round
        paths = written(paths.unionByName(_join(paths, jump, ["tree", "node", "nth"]).select(
            "tree", "leaf", "rank", "n_turns", "path_score", F.col("up").alias("node"),
            F.lit(0).cast("long").alias("nth"), (F.col("back") + F.lit(1 << k)).alias("back"))), "paths")
    return _join(paths, m.select("tree", "node", "nth", "role", "text"), ["tree", "node", "nth"]).select(
        "tree", "leaf", "rank", (F.col("n_turns") - 1 - F.col("back")).alias("turn"), "role", "text", "n_turns",
        "path_score")


def format_paths(paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, leaf, rank, formatted, loss (array of start, length in code points from 0).

    Control strings inside roles and texts are escaped reversibly; the loss mask covers the escaped texts of
    ``loss_role`` and nothing of the template."""
    piece = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(ROLE_END))
    body = escape(F.col("text"))
    turns = paths.select("tree", "leaf", "rank", "turn", piece.alias("head"), body.alias("body"),
                         (F.col("role") == loss_role).alias("lossy"))
    grouped = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct(
        "turn", "head", "body", "lossy"))).alias("t"))
    sizes = F.transform("t", lambda t: F.struct(
        (F.char_length(t["head"]) + F.char_length(t["body"]) + len(CLOSE)).cast("long").alias("whole"),
        F.char_length(t["head"]).cast("long").alias("head"), F.char_length(t["body"]).cast("long").alias("body"),
        t["lossy"].alias("lossy")))
    zero = F.struct(F.lit(0).cast("long").alias("at"),
                    F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    loss = F.aggregate(sizes, zero, lambda s, t: F.struct(
        (s["at"] + t["whole"]).alias("at"),
        F.when(t["lossy"], F.concat(s["spans"], F.array(F.struct(
            (s["at"] + t["head"]).alias("start"), t["body"].alias("length"))))).otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    text = F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return grouped.select("tree", "leaf", "rank", text.alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, array of (role, text), read back from its text alone."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, ROLE_END, 1), len(OPEN) + 1, 1 << 30), ROLE_ESCAPES).alias("role"),
        unescape(F.substring(p, (F.char_length(F.substring_index(p, ROLE_END, 1)) + len(ROLE_END) + 1).cast("int"),
                             F.char_length(p))).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
