"""Chat formatting: reply trees to conversations, in DataFrame operations only.

Root-to-leaf paths come from repeated self-joins with doubling: after round ``j`` every chosen leaf knows its
``2**j`` nearest ancestors and every message its ``2**j``-th one, so a thread of ten thousand replies takes fourteen
rounds. Paths are ranked by score within their tree before any text is read, and only chosen paths are formatted.

The template writes a turn as ``### role: text</turn>`` and a newline. Escapes are a backslash and one letter, and
no escape contains a control string, so an escaped text never holds ``###`` or ``</turn>`` and splitting is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanferry.shared import settle

TURN_START = "###"
TURN_END = "</turn>"
SEGMENT_TURNS = 256  # turns joined by one group before segments of a path are put together

# Control string and its escape, in the order of escaping; undone in reverse order.
_ESCAPES = (("\\", "\\b"), (TURN_START, "\\h"), (TURN_END, "\\l"))
_ROLE_ESCAPES = (*_ESCAPES, (":", "\\c"))


def escape(text: Column, pairs: Sequence[tuple[str, str]] = _ESCAPES) -> Column:
    """``text`` without control strings; reversible by :func:`unescape`."""
    for control, code in pairs:
        text = F.replace(text, F.lit(control), F.lit(code))
    return text


def unescape(text: Column, pairs: Sequence[tuple[str, str]] = _ESCAPES) -> Column:
    for control, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(control))
    return text


def reply_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Root-to-leaf paths: ``(tree_id, leaf_id, path_rank, path_score, node_id, up)``, one row per message of a path.

    ``messages(tree_id, node_id, parent_id, score)`` holds a ``(tree_id, node_id)`` once. A reply to nothing, to itself
    or to a message that does not exist is a root. ``up`` is the distance to the leaf. Paths are ranked by mean score,
    high first (null scores count 0), ties to the smaller leaf; the ``branches`` best of a tree are kept, all by default.
    Replies in a circle reach no root and are on no path.
    """
    nodes = settle(messages.select("tree_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score")))
    parents = nodes.select("tree_id", F.col("node_id").alias("parent_id")).distinct()
    step = settle(
        nodes.where(~F.col("parent_id").eqNullSafe(F.col("node_id")))
        .join(parents, ["tree_id", "parent_id"], "left_semi")
        .select("tree_id", "node_id", F.col("parent_id").alias("above"))
    )
    roots = nodes.join(step, ["tree_id", "node_id"], "left_anti").select("tree_id", "node_id")
    inner = step.select("tree_id", F.col("above").alias("node_id")).distinct()
    leaves = nodes.join(inner, ["tree_id", "node_id"], "left_anti")
    paths = leaves.select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("long").alias("up"))
    largest = nodes.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    distance, circular = 1, False
    while not step.isEmpty():
        if distance >= largest:
            circular = True
            break
        higher = paths.join(step, ["tree_id", "node_id"]).select(
            "tree_id", "leaf_id", F.col("above").alias("node_id"), (F.col("up") + distance).alias("up")
        )
        paths = settle(paths.unionByName(higher))
        beyond = step.select("tree_id", F.col("node_id").alias("above"), F.col("above").alias("far"))
        step = settle(step.join(beyond, ["tree_id", "above"]).select("tree_id", "node_id", F.col("far").alias("above")))
        distance *= 2
    if circular:
        reached = paths.join(roots, ["tree_id", "node_id"], "left_semi").select("tree_id", "leaf_id").distinct()
        paths = paths.join(reached, ["tree_id", "leaf_id"], "left_semi")
    scores = nodes.select("tree_id", "node_id", "score")
    ranked = (
        paths.join(scores, ["tree_id", "node_id"])
        .groupBy("tree_id", "leaf_id")
        .agg(F.avg("score").alias("path_score"))
        .withColumn("path_rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("path_score"), "leaf_id")))
    )
    if branches is not None:
        ranked = ranked.where(F.col("path_rank") <= branches)
    return paths.join(ranked, ["tree_id", "leaf_id"])


def format_conversations(messages: DataFrame, branches: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: ``tree_id, leaf_id, path_rank, path_score, n_turns, formatted, mask``.

    ``messages(tree_id, node_id, parent_id, role, text, score)``; see :func:`reply_paths` for trees, ranks and circles.
    Null roles and texts count as empty. Rows that repeat a ``(tree_id, node_id)`` count once (the least by parent, role
    and text); rows with a null tree or node are on no path. Extra columns are ignored.

    ``mask`` holds one entry per text of ``loss_role``: ``start`` and ``length`` in code points of ``formatted``, and the
    same place as ``turn`` and ``offset`` in that turn, for readers that go turn by turn. A conversation is one text by
    definition; its turns are joined in segments first, so the last step meets one row per 256 turns.
    """
    least = F.min(F.struct("parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score"))
    once = (
        messages.where("tree_id is not null and node_id is not null")
        .groupBy("tree_id", "node_id")
        .agg(least.alias("m"))
        .select("tree_id", "node_id", "m.*")
    )
    once = settle(once)
    head = F.concat(F.lit(f"{TURN_START} "), escape(F.col("role"), _ROLE_ESCAPES), F.lit(": "))
    body = escape(F.col("text"))
    blocks = once.select(
        "tree_id", "node_id",
        F.concat(head, body, F.lit(f"{TURN_END}\n")).alias("block"),
        F.length(head).alias("offset"),
        F.when(F.col("role") == loss_role, F.length(body)).alias("loss"),
    )
    turns = reply_paths(once, branches).join(blocks, ["tree_id", "node_id"])
    whole_path = ["tree_id", "leaf_id", "path_rank", "path_score"]
    # `up` falls along the path, so segments and turns are put in falling order.
    segment = F.floor(F.col("up") / SEGMENT_TURNS)
    turn = F.struct((-F.col("up")).alias("at"), "block", "offset", "loss", F.length("block").alias("chars"))
    segments = turns.groupBy(*whole_path, (-segment).alias("seg")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    begin = F.expr("transform(turns, (t, i) -> aggregate(slice(turns, 1, i), 0L, (s, x) -> s + x.chars))")
    segments = segments.withColumn("begin", begin).select(
        *whole_path, "seg",
        F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("block"),
        F.size("turns").alias("n"),
        F.expr("aggregate(turns, 0L, (s, x) -> s + x.chars)").alias("chars"),
        F.expr(
            "filter(transform(turns, (t, i) -> struct(i as turn, begin[i] + t.offset as start, t.offset as offset, t.loss as length)),"
            " t -> t.length is not null)"
        ).alias("mask"),
    )
    joined = segments.groupBy(*whole_path).agg(F.sort_array(F.collect_list(F.struct("seg", "block", "n", "chars", "mask"))).alias("s"))
    shifted = F.expr(
        "flatten(transform(s, (p, i) -> transform(p.mask, m -> struct("
        "m.turn + aggregate(slice(s, 1, i), 0, (a, x) -> a + x.n) as turn,"
        "m.start + aggregate(slice(s, 1, i), 0L, (a, x) -> a + x.chars) as start, m.offset as offset, m.length as length))))"
    )
    return joined.select(
        *whole_path,
        F.expr("aggregate(s, 0L, (a, x) -> a + x.n)").alias("n_turns"),
        F.array_join(F.transform("s", lambda p: p["block"]), "").alias("formatted"),
        shifted.alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``, unescaped."""
    blocks = F.filter(F.split(formatted, f"{TURN_END}\n"), lambda b: b != "")
    start = len(TURN_START) + 2

    def parsed(block: Column) -> Column:
        colon = F.instr(block, ": ")
        role = F.substring(block, F.lit(start), colon - start)
        return F.struct(
            unescape(role, _ROLE_ESCAPES).alias("role"),
            unescape(F.substring(block, colon + 2, F.length(block))).alias("text"),
        )

    return F.transform(blocks, parsed)


def read_masked(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, in order and unescaped."""
    blocks = F.split(formatted, f"{TURN_END}\n")
    return F.transform(mask, lambda m: unescape(F.substring(F.get(blocks, m["turn"].cast("int")), m["offset"] + 1, m["length"])))
