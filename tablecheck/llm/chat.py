"""Reply trees as chat conversations.

Messages point to the message they answer. Paths from root to leaf are enumerated by
self-joins that double the distance each message sees, so a path of n messages takes log2(n)
joins up and as many down. The leaves of a tree are ranked by the score of their paths, and
each chosen path is formatted as one conversation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.llm.helpers import named
from tablecheck.session import pin

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What a tokenizer may read as control; fixed values of common chat templates.
CONTROL = (START, SEP, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]",
           "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"


def escaped(text: Column) -> Column:
    """Text in which no control string occurs: a backslash behind its first character.

    Backslashes are doubled, so ``unescaped`` gives back the text.
    """
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    inner = "|".join(re.escape(c[1:]) for c in CONTROL)
    return F.regexp_replace(doubled, f"([<\\[])(?={inner})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _same_tree(a: str, b: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))


def reply_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, up, id): the messages of the chosen paths, ``up`` steps above the leaf.

    ``messages`` has tree, id, parent and score. A path's score is the mean score of its
    messages (null counts as 0); ties go to the least leaf id. A message whose parent is
    null or not in its tree is a root. Messages with a null id, or on or below a cycle, are on no
    path. Of messages with one id the one with the highest score counts, then the least parent.
    """
    first = Window.partitionBy("tree", "id").orderBy(F.desc_nulls_last("score"), F.asc_nulls_first("parent"))
    nodes = messages.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = nodes.where("id is not null").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    known = nodes.alias("n").join(nodes.select("tree", "id").alias("p"), _same_tree("n", "p") & F.expr("n.parent = p.id"), "left")
    state = pin(known.select("n.tree", "n.id", F.col("p.id").alias("above"), F.col("n.score").alias("total"), F.lit(1).alias("hops")), "replies")
    jumps, waiting = [], None
    while True:
        # Only messages that do not see their root yet look further up.
        climbing = state.where("above is not null")
        open_now = climbing.count()
        if open_now == 0 or open_now == waiting:
            break
        jumps.append(climbing)
        waiting = open_now
        joined = climbing.alias("s").join(state.alias("t"), _same_tree("s", "t") & F.expr("s.above = t.id"), "left")
        higher = joined.select(
            "s.tree", "s.id", F.col("t.above").alias("above"),
            (F.col("s.total") + F.coalesce("t.total", F.lit(0.0))).alias("total"),
            (F.col("s.hops") + F.coalesce("t.hops", F.lit(0))).alias("hops"),
        )
        state = pin(state.where("above is null").unionByName(higher), "replies")
    rooted = state.where("above is null")
    parents = (jumps[0] if jumps else state).where("above is not null").select("tree", F.col("above").alias("id"))
    leaves = rooted.alias("r").join(parents.alias("p"), _same_tree("r", "p") & F.expr("r.id = p.id"), "left_anti")
    best = Window.partitionBy("tree").orderBy((F.col("total") / F.col("hops")).desc(), "id")
    chosen = leaves.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= per_tree)
    path = chosen.select("tree", F.col("id").alias("leaf"), F.lit(0).alias("up"), "id")
    for power in reversed(range(len(jumps))):
        higher = path.alias("s").join(
            jumps[power].alias("t"), _same_tree("s", "t") & F.expr("s.id = t.id")
        )
        path = pin(path.union(higher.select("s.tree", "s.leaf", F.col("s.up") + 2**power, "t.above")), "path")
    return path


def format_chats(messages: DataFrame, per_tree: int = 1, reply_role: str = "assistant") -> DataFrame:
    """(tree, leaf, text, loss): each chosen path as one text.

    ``messages`` has tree, id, parent, score, role and text; see ``reply_paths``. A turn is
    START role SEP text END and a line end, with role and text escaped; null roles and texts
    are empty. ``loss`` lists (start, end) of the texts of ``reply_role`` in characters of
    ``text``. An empty table gives no rows; other columns do not matter.
    """
    path = reply_paths(messages, per_tree)
    first = Window.partitionBy("tree", "id").orderBy(
        F.desc_nulls_last("score"), F.asc_nulls_first("parent"), F.asc_nulls_first("role"), F.asc_nulls_first("text")
    )
    words = messages.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    turns = path.alias("p").join(words.alias("w"), _same_tree("p", "w") & F.expr("p.id = w.id"))
    role, text = F.coalesce("w.role", F.lit("")), F.coalesce("w.text", F.lit(""))
    head = F.concat(F.lit(START), escaped(role), F.lit(SEP))
    turns = turns.select(
        "p.tree", "p.leaf", "p.up", (role == reply_role).alias("reply"), F.length(head).alias("head"),
        escaped(text).alias("body"), F.concat(head, escaped(text), F.lit(END + "\n")).alias("turn"),
    )
    down = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    start = F.sum(F.length("turn")).over(down) - F.length("turn") + F.col("head")
    turns = turns.withColumn("start", start)
    span = F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end"))
    # One conversation is one row, so its turns meet in one task.
    chats = turns.groupBy("tree", "leaf").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("nth"), "turn"))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("reply"), span))).alias("loss"),
    )
    return chats.select("tree", "leaf", F.array_join("turns.turn", "").alias("text"), "loss")


def parse_chats(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns``, an array of (role, text), and ``loss_text`` read from text and loss."""
    pieces = F.split("text", re.escape(END) + "\n")
    turns = F.transform(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(len(START) + 1)), SEP, 1)).alias("role"),
            unescaped(F.substring_index(p, SEP, -1)).alias("text"),
        ),
    )
    marked = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return chats.withColumn("turns", turns).withColumn("loss_text", F.array_join(marked, ""))


def linear_messages(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Conversations in turns as messages: each turn answers the one before it.

    Turns of one number are ordered by role and text.
    """
    order = Window.partitionBy(named(conv_col)).orderBy(
        F.asc_nulls_first(turn_col), F.asc_nulls_first("role"), F.asc_nulls_first("text")
    )
    rows = rows.select(named(conv_col).alias("tree"), F.row_number().over(order).alias("id"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(0.0))
