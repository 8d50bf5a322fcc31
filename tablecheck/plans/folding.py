"""Equal rows as one row with a count, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One folded row is unfolded in steps of this many copies.
UNFOLD_STEP = 100_000


def fold(
    left: DataFrame, right: DataFrame, ks: Sequence[str], vs: Sequence[str], by_key: bool = False
) -> DataFrame:
    """``(keys, values, n_left, n_right)``: how often each whole row occurs on each side.

    Grouping by the whole row spreads a hot key over all tasks, and equal copies are
    counted before the shuffle. ``by_key`` is for tables without a hot key: rows are
    shuffled by their keys, so that what is done within a key next needs no other shuffle.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    tagged = left.select(*ks, *vs, one.alias("l"), none.alias("r")).unionByName(
        right.select(*ks, *vs, none.alias("l"), one.alias("r"))
    )
    if by_key:
        tagged = tagged.repartition(*ks)
    return tagged.groupBy(*ks, *vs).agg(
        F.sum("l").alias("n_left"), F.sum("r").alias("n_right")
    )


def unfold(df: DataFrame, names: Sequence[str], max_copies: int) -> DataFrame:
    """One row per copy, with ``nth`` telling copies apart.

    A row with very many copies is unfolded by several tasks. ``nth`` depends on the data
    alone, so a task that is run again after a lost executor deals out the same numbers.
    """
    step = F.lit(0).cast("bigint")
    copies = F.col("copies")
    if max_copies > UNFOLD_STEP:
        steps = F.sequence(step, F.floor((copies - 1) / UNFOLD_STEP))
        step = F.col("step")
        part = F.least(F.lit(UNFOLD_STEP).cast("bigint"), copies - step * UNFOLD_STEP)
        df = (
            df.withColumn("step", F.explode(steps))
            .withColumn("copies", part)
            .repartition(*names, "step")
        )
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("each")
    return df.select(*names, step.alias("step"), each).select(
        *names, (F.col("step") * UNFOLD_STEP + F.col("each")).alias("nth")
    )
