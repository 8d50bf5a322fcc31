"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.session import pin

MAX_ROUNDS = 100


def _stars(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours of each node to the least of them and the node.

    ``pairs`` is (node, near). The least neighbour is a plain minimum, combined before the
    shuffle, and is joined back to the pairs, so adaptive execution may split the pairs of
    a node with very many neighbours.
    """
    least = pairs.groupBy("node").agg(F.min("near").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    joined = pairs.join(least, "node")
    if larger:  # each larger neighbour to the least
        return joined.where("near > node").select(F.col("near").alias("a"), F.col("least").alias("b"))
    # each smaller neighbour, and the node, to the least
    smaller = joined.select(F.col("near").alias("a"), F.col("least").alias("b"))
    return smaller.union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node it reaches.

    Alternates large-star and small-star steps until the edges are stars. Each round is
    written to the shared scratch folder. Ends after about log2(longest chain) rounds;
    loops and repeated edges are ignored. An empty edge list has no nodes.
    """
    edges = pin(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(
            edges.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
        large = _stars(both, larger=True).where("a <> b").distinct()
        down = large.select(F.col("a").alias("node"), F.col("b").alias("near"))
        edges = pin(_stars(down, larger=False).where("a <> b").distinct(), "edges")
        seen = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
