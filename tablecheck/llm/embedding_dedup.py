"""Embedding near-dedup: a navigable graph per shard, queried by every shard of its label.

Equal vectors of a label are one class. The classes are dealt over shards by hash, each shard
becomes a hierarchical navigable small-world graph, and each pair of shards is one task that queries the
graph of one with the vectors of the other. In each task the links of some queries are also counted
exactly; while the search misses too many of them its beam is doubled, up to the whole shard. Cosines
of what was found are verified in double precision, and a task returns the number of links of each
class with a tree of the classes that they join, so crowded places are not written out as pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.llm import hnsw
from tablecheck.llm.components import components
from tablecheck.llm.helpers import named
from tablecheck.session import pin

THRESHOLD = 0.93
#: Classes in a shard, and numbers in the vectors of a shard.
SHARD_ROWS, SHARD_NUMBERS = 8192, 2_000_000
#: Beam of the first search, queries that are audited in each task, and the share of links they must find.
BEAM, AUDITED, RECALL = 32, 256, 0.99
#: Queries that run together.
BATCH = 256
#: Tasks at most over which shards, or pairs of them, are dealt.
MAX_TASKS = 20_000
#: Single precision may be off by so much.
SLACK = 1e-4


def is_direction(vector: Column) -> Column:
    """Whether a vector can link: not null, of finite numbers, not all of them zero."""
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(plain(x), F.lit(False))) & some, F.lit(False))


def units(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as lines of unit length, in double precision."""
    whole = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = np.asarray(whole.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    # By the greatest number first: squares of very large or small ones leave the range.
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _found(graph: hnsw.Graph, queries: np.ndarray, own: np.ndarray | None, beam: int, low: float) -> np.ndarray:
    """Marks (query, node) of similarity ``low`` or more that a search with this beam looks at."""
    out = np.zeros((len(queries), len(graph.vectors)), bool)
    for k in range(0, len(queries), BATCH):
        mine = None if own is None else own[k : k + BATCH]
        out[k : k + BATCH] = hnsw.looked_at(graph, queries[k : k + BATCH], beam, low, mine) >= low
    return out


def linked(
    graph: hnsw.Graph, nodes: np.ndarray, queries: np.ndarray, same: bool, threshold: float,
    beam: int = BEAM, audited: int = AUDITED, recall: float = RECALL,
) -> np.ndarray:
    """Marks the (query, node) whose cosine is ``threshold`` or more and that the graph leads to.

    ``nodes`` and ``queries`` are unit vectors in double precision; with ``same`` they are the same.
    """
    single = queries.astype(np.float32)
    low = np.float32(threshold - SLACK)
    own = np.arange(len(queries)) if same else None
    sample = np.unique(np.linspace(0, len(queries) - 1, min(audited, len(queries))).astype(int))
    truth = queries[sample] @ nodes.T >= threshold
    if same:
        truth[np.arange(len(sample)), sample] = False
    beam = min(beam, len(nodes))
    while beam < len(nodes):
        seen = _found(graph, single[sample], None if own is None else own[sample], beam, low)
        if (seen & truth).sum() >= recall * truth.sum():
            break
        beam = min(2 * beam, len(nodes))
    out = _found(graph, single, own, beam, low)
    if same:
        out |= out.T
        np.fill_diagonal(out, False)
    for k in range(0, len(out), BATCH):
        line, node = np.nonzero(out[k : k + BATCH])
        out[k + line, node] = hnsw.likeness(queries, k + line, nodes, node) >= threshold
    return out


def trees(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the connected part of each line and of each column, -1 without links."""
    across = np.ascontiguousarray(links.T)
    lines, columns = np.full(len(links), -1, np.int64), np.full(len(across), -1, np.int64)
    for part in np.flatnonzero(links.any(axis=1)).tolist():
        if lines[part] >= 0:
            continue
        front = np.array([part])
        while len(front):
            lines[front] = part
            to = np.flatnonzero(links[front].any(axis=0) & (columns < 0))
            columns[to] = part
            front = np.flatnonzero(across[to].any(axis=0) & (lines < 0))
    return lines, columns


def _sums(links: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each line the weights of its columns, exactly."""
    out = np.zeros(len(links), np.int64)
    for k in range(0, len(links), BATCH):
        out[k : k + BATCH] = np.where(links[k : k + BATCH], weights, 0).sum(axis=1)
    return out


def class_links(classes: DataFrame, threshold: float, shard_rows: int, shard_numbers: int) -> DataFrame:
    """(a, b, links): for each class with links inside a pair of shards, how many vectors it links
    to there, and a class of the same connected part; ``classes`` as in ``near_vectors``."""
    rows = F.least(F.lit(shard_rows), F.greatest(F.lit(1), F.floor(F.lit(shard_numbers) / F.col("dim"))))
    groups = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / rows).cast("long").alias("shards"))
    dealt = classes.join(groups, ["label", "dim"]).withColumn(
        "shard", F.pmod(F.xxhash64("vector"), F.col("shards"))
    )
    vector = classes.schema["vector"].dataType
    kind = (
        T.StructType().add("label", classes.schema["label"].dataType).add("dim", "integer").add("shards", "long")
        .add("shard", "long").add("nodes", T.ArrayType(T.LongType())).add("weights", T.ArrayType(T.LongType()))
        .add("vectors", T.ArrayType(vector)).add("links", "binary")
    )

    def build(table: pa.Table) -> pa.Table:
        # In an order that does not follow the values, and is the same if the task runs again.
        table = table.sort_by("node")
        order = np.random.default_rng(0).permutation(table.num_rows)
        table = table.take(pa.array(order))
        vectors = table["vector"].combine_chunks()
        graph = hnsw.build(units(vectors, table["dim"][0].as_py()))
        one = lambda column: pa.array([column.to_pylist()], pa.list_(column.type))
        lists = pa.ListArray.from_arrays(pa.array([0, len(vectors)], pa.int32()), vectors)
        return pa.table(
            [table[c].slice(0, 1) for c in ("label", "dim", "shards", "shard")]
            + [one(table["node"]), one(table["n"]), lists, pa.array([hnsw.links_to_bytes(graph)])],
            names=kind.names,
        )

    # A graph is small to read and long to work on, so Spark must not join small partitions here.
    shards = F.col("shards")
    much = groups.agg(F.sum(shards), F.sum(shards * (shards + 1) / 2)).first()
    spread = [int(min(MAX_TASKS, max(1, 2 * (m or 0)))) for m in much]
    apart = dealt.repartition(spread[0], "label", "dim", "shard").groupBy("label", "dim", "shard")
    shards = pin(apart.applyInArrow(build, kind), "graphs")
    # Each pair of shards of a label once: the graph of one, and the vectors of the other.
    last, own = F.col("shards") - 1, F.col("shard")
    graphs = shards.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), own))).withColumn("j", own)
    queries = shards.withColumn("links", F.lit(None).cast("binary")).where(own < last)
    queries = queries.withColumn("j", F.explode(F.sequence(own + 1, last))).withColumn("i", own)

    def meet(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        side = {}
        for at in range(table.num_rows):
            row = table.slice(at, 1)
            side[row["links"][0].is_valid] = (
                np.array(row["nodes"][0].as_py(), np.int64), np.array(row["weights"][0].as_py(), np.int64),
                units(row["vectors"].combine_chunks().flatten(), dim), row["links"][0].as_py(),
            )
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dim)), None)
        nodes, weights, vectors, links = side.get(True, empty)
        same = table["i"][0].as_py() == table["j"][0].as_py()
        ids, times, asked, _ = side[True] if same else side.get(False, empty)
        if not len(nodes) or not len(ids):  # a shard may have got no class
            return pa.table([pa.array([], pa.int64())] * 3, names=["a", "b", "links"])
        found = linked(hnsw.from_bytes(vectors, links), vectors, asked, same, threshold)
        sums = [_sums(found, weights)]
        if same:
            np.fill_diagonal(found, True)  # a class as a line is itself as a column
        else:
            sums.append(_sums(np.ascontiguousarray(found.T), times))
        out = zip([ids, nodes], trees(found), sums)
        a, part, links = (np.concatenate(x) for x in zip(*out))
        some = links > 0
        return pa.table([a[some], ids[part[some]], links[some]], names=["a", "b", "links"])

    names = ["label", "dim", "i", "j", "nodes", "weights", "vectors", "links"]
    pairs = graphs.select(*names).union(queries.select(*names))
    pairs = pairs.repartition(spread[1], "label", "dim", "i", "j")
    return pairs.groupBy("label", "dim", "i", "j").applyInArrow(meet, "a long, b long, links long")


def near_vectors(
    df: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", shard_rows: int = SHARD_ROWS, shard_numbers: int = SHARD_NUMBERS,
) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Vectors of equal labels and lengths link at a cosine of ``threshold`` or more, in double
    precision. n_links counts the other vectors linked directly, component_id is the least id reached over
    links, itself included, and kept is whether that is the row's own id. A pair is linked if the search
    of its shards finds it; the audit holds that to RECALL of the links of the audited queries, and if
    those have none it says nothing. No pair below the threshold is linked.

    Vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing, nor do
    rows without a label. Repeated rows and equal vectors link with each other. Null ids take part; a component of
    nothing but null ids has a null component_id and is not kept. An empty table gives no rows. Other
    columns do not matter and are not returned. A label of any size is cut into shards of
    ``shard_rows`` classes (fewer where vectors are long, ``shard_numbers`` in all); every shard
    meets every other of its label, so shuffles grow with the square of the shards of a label.
    """
    source = df.schema[vector_col].dataType
    if not isinstance(source, T.ArrayType):
        raise ValueError(f"{vector_col} must be an array of numbers")
    number = T.FloatType() if source.elementType == T.FloatType() else T.DoubleType()
    vector = named(vector_col).cast(T.ArrayType(number))
    rows = df.select(named(id_col).alias("vec_id"), named(label_col).alias("label"), vector.alias("vector"))
    rows = rows.withColumn("links_at_all", is_direction(F.col("vector")) & F.col("label").isNotNull())
    able = rows.where("links_at_all").drop("links_at_all")
    # Counted before the shuffle, so a vector of very many rows is a few of them.
    classes = able.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    # Written with their numbers, which must not change if a task runs again.
    classes = pin(
        classes.select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("node")), "classes"
    )
    found = pin(class_links(classes, threshold, shard_rows, shard_numbers), "links")
    roots = components(found.select("a", "b"))
    known = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = known.join(least, "root").join(counts, "node", "left").select(
        "label", "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    joined = able.join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("links_at_all")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return joined.union(alone).withColumn("kept", kept)
