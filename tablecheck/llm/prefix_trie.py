"""The prefix trie of conversations by ROLLUP over positional turn-id columns.

A conversation lies in blocks of BLOCK turns, one row for each block, with a column for each turn's
id. ``GROUP BY block, prior, ROLLUP (t0, ...)`` gives all prefixes of all conversations in one
aggregation, and ``grouping_id`` tells how long each one is. A block is keyed by the node
that the blocks before it end in: sums over the turns so far of hashes of turn and place, 128
bits. So blocks need no loop, and a conversation of any length is many small rows.

Sums over the nodes below a node come from a second ROLLUP: each node is counted by its least
member, which is in all the prefixes above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.llm.helpers import named
from tablecheck.session import pin

BLOCK = 8
#: Blocks of a conversation that one window sums up; longer ones are summed in such spans.
SPAN = 4096
_WORDS = [f"w{i}" for i in range(4)]
_PRIOR = [f"p{i}" for i in range(4)]
_TURNS = [f"t{i}" for i in range(BLOCK)]
_SIZES = [f"b{i}" for i in range(BLOCK)]


def number_turns(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, pos, role, text): turns numbered from 0 in each conversation.

    Turns are ordered by turn number, null first, then by role and text; null roles and texts are
    empty. Rows without a conversation id belong to none and are left out. An empty table gives no
    rows; other columns do not matter. Rows are sorted by ranges, so a conversation of very many
    turns is dealt over tasks and numbered in parts that are shifted by the parts before.
    """
    text = lambda c: F.coalesce(named(c), F.lit(""))
    turns = rows.where(named(conv_col).isNotNull()).select(
        named(conv_col).alias("conv_id"), named(turn_col).alias("turn"),
        text(role_col).alias("role"), text(text_col).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written before it is used: a task that runs again must not number otherwise.
    at = pin(ranged.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("at")), "turns")
    part = F.shiftright("at", 33).alias("part")
    parts = at.groupBy("conv_id", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select("conv_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    placed = at.withColumn("part", part).join(shift, ["conv_id", "part"])
    return placed.select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "role", "text")


def turn_id(role: Column, text: Column) -> Column:
    """SHA-256 of a turn's role and text; equal only for equal turns."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def _place_words(turn: Column, pos: Column) -> list[Column]:
    """Four 32-bit words of hashes of a turn's id and place; zero for no turn."""
    one, two = F.xxhash64(turn, pos), F.xxhash64(pos, F.lit("second"), turn)
    low = F.lit(0xFFFFFFFF).cast("long")
    words = [w for h in (one, two) for w in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32))]
    return [F.when(turn.isNull(), F.lit(0).cast("long")).otherwise(w) for w in words]


def _sums_before(rows: DataFrame, names: list[str], ascending: bool = True) -> DataFrame:
    """``rows`` (conv_id, block, ...) with each of ``names`` as its sum over the blocks of the
    conversation before (or behind) that block."""
    span, order = F.floor(F.col("block") / SPAN), F.col("block" if ascending else "_behind")
    rows = rows.withColumn("_span", span).withColumn("_behind", -F.col("block"))
    near = Window.partitionBy("conv_id", "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    far = Window.partitionBy("conv_id").orderBy(F.col("_span") if ascending else -F.col("_span"))
    far = far.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    spans = rows.groupBy("conv_id", "_span").agg(*[F.sum(n).alias(f"_{n}") for n in names])
    spans = spans.select("conv_id", "_span", *[F.coalesce(F.sum(f"_{n}").over(far), zero).alias(f"_{n}") for n in names])
    inside = rows.select(
        *[c for c in rows.columns if c not in names],
        *[F.coalesce(F.sum(n).over(near), zero).alias(n) for n in names],
    )
    out = inside.join(spans, ["conv_id", "_span"])
    kept = [F.col(n) + F.col(f"_{n}") if n in names else F.col(n) for n in rows.columns]
    return out.select(*[c.alias(n) for c, n in zip(kept, rows.columns)]).drop("_span", "_behind")


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, block, t0.., b0.., n, w0.., p0..): one row for each block of each conversation.

    w: the block's own words, summed; p: those of all blocks before it.
    """
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    at = F.pmod("pos", F.lit(BLOCK))
    ids = turns.select(
        "conv_id", block, at.alias("at"), F.col("id"), "size",
        *[w.alias(n) for w, n in zip(_place_words(F.col("id"), F.col("pos")), _WORDS)],
    )
    here = lambda i, c: F.max(F.when(F.col("at") == i, F.col(c)))
    rows = ids.groupBy("conv_id", "block").agg(
        *[here(i, "id").alias(t) for i, t in enumerate(_TURNS)],
        *[here(i, "size").alias(b) for i, b in enumerate(_SIZES)],
        F.count("*").alias("n"), *[F.sum(w).alias(w) for w in _WORDS],
    )
    rows = rows.select("*", *[F.col(w).alias(p) for w, p in zip(_WORDS, _PRIOR)])
    return pin(_sums_before(rows, _PRIOR), "blocks")


def _rollup(blocks: DataFrame, measures: str) -> DataFrame:
    """``measures`` of every prefix that ends in a turn, with its level in the block."""
    spark = blocks.sparkSession
    keys = ", ".join(["block", *_PRIOR])
    found = spark.sql(
        f"SELECT {keys}, {', '.join(_TURNS)}, {BLOCK} - bit_count(grouping_id()) AS level, {measures} "
        f"FROM {{blocks}} GROUP BY {keys}, ROLLUP ({', '.join(_TURNS)})",
        blocks=blocks,
    )
    # Where the last turn of a level is null, conversations have ended before.
    return found.where(F.element_at(F.array(*_TURNS), F.greatest("level", F.lit(1)).cast("int")).isNotNull() & (F.col("level") > 0))


def _nodes(blocks: DataFrame) -> DataFrame:
    """(conv_id, depth, n_convs, weight, k0.., u0..): all nodes but the root.

    k is the key of the node and u the key of the node above it.
    """
    sizes = ", ".join(f"max({b}) AS {b}" for b in _SIZES)
    found = _rollup(blocks, f"min(conv_id) AS conv_id, count(*) AS n_convs, {sizes}")
    words = [_place_words(F.col(t), F.col("block") * BLOCK + i) for i, t in enumerate(_TURNS)]
    key = lambda w, last: F.col(_PRIOR[w]) + reduce(add, [
        F.when(F.col("level") > i + last, words[i][w]).otherwise(F.lit(0).cast("long")) for i in range(BLOCK)
    ])
    size = F.element_at(F.array(*_SIZES), F.col("level").cast("int"))
    out = found.select(
        "conv_id", (F.col("block") * BLOCK + F.col("level")).cast("long").alias("depth"), "n_convs",
        ((F.col("n_convs") - 1) * size).alias("weight"),
        *[key(w, 0).alias(f"k{w}") for w in range(4)], *[key(w, 1).alias(f"u{w}") for w in range(4)],
    )
    return pin(out, "nodes")


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of each node's ``member`` ids, ascending, as text.

    Ids stream through the hash in sorted order, so a node where very many conversations end
    takes one task some time but no memory.
    """
    dealt = ends.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for c, d, m in zip(*(batch[n].to_pylist() for n in ("conv_id", "depth", "member"))):
                if (c, d) != node:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (c, d), hashlib.sha256(str(m).encode())
                else:
                    sha.update(f",{m}".encode())
            yield rows(out)
        if node is not None:
            yield rows([(*node, sha.hexdigest())])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "depth", "ends_sha256"]
        )

    return dealt.mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row for each distinct sequence of first turns, from the empty one (depth 0) on.

    ``turns`` has conv_id (whole numbers), pos (from 0, without gaps), role, text and size, what
    a turn costs; see ``number_turns``. ``conversations`` lists all conv_ids, for those that
    have no turns; without it they are those of ``turns``. Returns conv_id, the least member; depth;
    parent_conv_id, the conv_id of the node above (null for depth 0); n_convs, members;
    n_children; n_leaves, the nodes without children below or at it; saved, the sum of
    (n_convs - 1) * size of the last turn over the nodes below and itself; ends_sha256 of the
    ids of the conversations that end here, ascending, joined by commas.

    Null roles and texts count as empty and null sizes as 0. Turns without conv_id are left out. Without any
    conversation there are no nodes. Repeated conversations are members of the same nodes; a list of
    conversations may name one twice. Texts of any length go in as digests; other columns do not matter.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ids = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("pos").cast("long").alias("pos"),
        turn_id(text("role"), text("text")).alias("id"), F.coalesce(F.col("size").cast("long"), zero).alias("size"),
    )
    blocks = _blocks(ids)
    nodes = _nodes(blocks)
    named_ids = blocks.select("conv_id") if conversations is None else blocks.select("conv_id").union(
        conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"))
    )
    everyone = named_ids.distinct()
    root = everyone.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    top = F.lit(root["conv_id"]).cast("long")

    up = nodes.select(
        F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), *[F.col(f"k{w}").alias(f"u{w}") for w in range(4)]
    )
    linked = nodes.join(up, ["depth", *[f"u{w}" for w in range(4)]], "left")
    linked = pin(linked.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", top).alias("parent_conv_id"), "n_convs", "weight",
    ), "linked")
    children = linked.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children")
    )

    # What each conversation stands for: the nodes of which it is the least member.
    leaves = linked.join(children, ["conv_id", "depth"], "left_anti").select("conv_id", one.alias("leaf"))
    at = F.pmod(F.col("depth") - 1, F.lit(BLOCK))
    own = linked.groupBy("conv_id", F.floor((F.col("depth") - 1) / BLOCK).alias("block")).agg(
        *[F.sum(F.when(at == i, F.col("weight"))).alias(f"v{i}") for i in range(BLOCK)]
    )
    owned = blocks.select("conv_id", "block", *_PRIOR, *_TURNS).join(own, ["conv_id", "block"], "left")
    owned = owned.join(leaves, "conv_id", "left").fillna(0, [f"v{i}" for i in range(BLOCK)] + ["leaf"])
    later = owned.select("conv_id", "block", reduce(add, [F.col(f"v{i}") for i in range(BLOCK)]).alias("later"))
    owned = owned.join(_sums_before(later, ["later"], ascending=False), ["conv_id", "block"])
    below = [reduce(add, [F.col(f"v{k}") for k in range(i, BLOCK)], F.col("later")).alias(f"s{i}") for i in range(BLOCK)]
    sums = ", ".join(f"sum(s{i}) AS s{i}" for i in range(BLOCK))
    found = _rollup(owned.select("conv_id", "block", *_PRIOR, *_TURNS, "leaf", *below), f"min(conv_id) AS conv_id, sum(leaf) AS n_leaves, {sums}")
    totals = found.select(
        "conv_id", (F.col("block") * BLOCK + F.col("level")).cast("long").alias("depth"), "n_leaves",
        F.element_at(F.array(*[f"s{i}" for i in range(BLOCK)]), F.col("level").cast("int")).alias("saved"),
    )

    # Where each conversation ends: its last block's key, or the root.
    last = blocks.select(
        "conv_id", (F.col("block") * BLOCK + F.col("n")).alias("depth"), *[(F.col(p) + F.col(w)).alias(f"k{i}") for i, (p, w) in enumerate(zip(_PRIOR, _WORDS))]
    )
    full = blocks.groupBy("conv_id").agg(F.sum("n").alias("depth"))
    last = last.join(full, ["conv_id", "depth"]).withColumnRenamed("conv_id", "member")
    ends = last.join(nodes, ["depth", *[f"k{w}" for w in range(4)]]).select("conv_id", "depth", "member")
    silent = everyone.join(full, "conv_id", "left_anti").select(F.col("conv_id").alias("member"))
    ends = ends.union(silent.select(top, zero, "member"))

    # The root has the sums over all nodes; it is a leaf itself if there are no others.
    whole = linked.join(children, ["conv_id", "depth"], "left").agg(
        F.lit(root["n_convs"]).cast("long").alias("n_convs"), F.count_if(F.col("depth") == 1).alias("n_children"),
        F.greatest(F.count_if(F.col("n_children").isNull()), one).alias("n_leaves"),
        F.coalesce(F.sum("weight"), zero).alias("saved"),
    ).where("n_convs > 0")
    below_top = linked.join(totals, ["conv_id", "depth"]).join(children, ["conv_id", "depth"], "left")
    out = below_top.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved",
    ).union(whole.select(top, zero, F.lit(None).cast("long"), "n_convs", "n_children", "n_leaves", "saved"))
    nothing = F.sha2(F.encode(F.lit(""), "UTF-8"), 256)
    return out.join(_ends_digest(ends), ["conv_id", "depth"], "left").select(
        *out.columns, F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )
