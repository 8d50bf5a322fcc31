"""The full outer join of two keyed tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.plans.folding import unfold
from tablecheck.plans.keys import broadcast_measured, key_counts, null_safe
from tablecheck.session import pin

# From this number of text keys on, a hash of them is compared first.
HASHED_TEXTS = 3
# Pairs that one task may make, for each row it may hold.
PAIRS_PER_ROW = 10


def full_outer(
    left: DataFrame, right: DataFrame, ks: Sequence[str], vs: Sequence[str],
    null_ks: Sequence[str], also_on: Sequence[str] = (), how: str = "full",
) -> DataFrame:
    """Rows ``(keys, l0.., r0.., side)`` of a full outer join: one exchange per side, and
    none for a side already bucketed by these keys.

    The keys ``null_ks`` may be null on both sides, and null meets null. Elsewhere plain
    equality is the same, and cheaper. Many text keys get a hash of them all in front, so
    that sorting and merging rarely look at the texts.
    """
    texts = [k for k in ks if left.schema[k].dataType.typeName() == "string"]
    hashed = [F.xxhash64(*texts)] if len(texts) >= HASHED_TEXTS else []

    def renamed(df: DataFrame, mark: str) -> DataFrame:
        return df.select(
            *[F.col(k).alias(f"{mark}{k}") for k in ks],
            *[F.col(v).alias(f"{mark}{v[1:]}") for v in vs],
            *[F.col(c).alias(f"{mark}_{c}") for c in also_on],
            *[h.alias(f"{mark}_hash") for h in hashed],
            F.lit(True).alias(f"has_{mark}"),
        )

    same = [F.col("l_hash") == F.col("r_hash")] if hashed else []
    same += [
        F.col(f"l{k}").eqNullSafe(F.col(f"r{k}")) if k in null_ks
        else F.col(f"l{k}") == F.col(f"r{k}")
        for k in ks
    ]
    same += [F.col(f"l_{name}") == F.col(f"r_{name}") for name in also_on]
    condition = reduce(and_, same)
    joined = renamed(left, "l").join(renamed(right, "r"), condition, how)
    side = (
        F.when(F.col("has_r").isNull(), "left_only")
        .when(F.col("has_l").isNull(), "right_only")
        .otherwise("both")
    )
    return joined.select(
        *[F.coalesce(F.col(f"l{k}"), F.col(f"r{k}")).alias(k) for k in ks],
        *[F.col(f"{mark}{v[1:]}") for v in vs for mark in "lr"],
        side.alias("side"),
    )


def fan_out(
    left: DataFrame, right: DataFrame, ks: Sequence[str], vs: Sequence[str],
    null_ks: Sequence[str], max_copies: int, hot_rows: int,
) -> DataFrame:
    """Like ``full_outer`` when keys repeat: every left copy meets every right copy.

    A key that makes more pairs, or has more rows, than a task should hold is dealt over a
    grid: its left rows over the lines, its right rows over the columns, each repeated along
    its line or column. A cell has about ``PAIRS_PER_ROW * hot_rows`` pairs at most.
    """
    limit = PAIRS_PER_ROW * hot_rows
    if max_copies <= hot_rows and max_copies**2 <= limit:
        return full_outer(left, right, ks, vs, null_ks)

    n_left, n_right = F.col("n_left"), F.col("n_right")
    pairs = n_left.cast("decimal(19,0)") * n_right
    hot = key_counts(left, right, ks).filter((pairs > limit) | (F.greatest(n_left, n_right) > hot_rows))
    # A cell is a square, or as long as needed where the other side has few rows.
    edge = F.lit(int(limit**0.5))
    few = F.greatest(F.least(n_left, n_right, edge), F.lit(1))
    length = F.least(F.floor(F.lit(limit) / few), F.lit(hot_rows))
    wide = n_left >= n_right
    lines = F.ceil(n_left / F.when(wide, length).otherwise(few))
    columns = F.ceil(n_right / F.when(wide, few).otherwise(length))
    hot = hot.select(
        *[F.col(k).alias(f"h{k}") for k in ks], (n_left > 0).alias("in_left"),
        (n_right > 0).alias("in_right"), F.greatest(lines, F.lit(1)).cast("int").alias("lines"),
        F.greatest(columns, F.lit(1)).cast("int").alias("columns"),
    )
    hot = broadcast_measured(pin(hot, "hot-keys"))

    on = null_safe([F.col(k) for k in ks], [F.col(f"h{k}") for k in ks])

    def dealt(df: DataFrame, own: str) -> DataFrame:
        names = [*ks, *vs, "in_left", "in_right", "lines", "columns"]
        copies = df.select(*ks, *vs).join(hot, on).groupBy(*names).agg(F.count("*").alias("copies"))
        place = F.pmod(F.xxhash64(*ks, *vs, "nth"), F.col(own)).cast("int")
        return unfold(copies, names, max_copies).withColumn(f"at_{own}", place)

    def along(df: DataFrame, other: str) -> DataFrame:
        both = df.where("in_left and in_right")
        every = F.sequence(F.lit(0), F.col(other) - 1)
        return both.select(*ks, *vs, f"at_{'columns' if other == 'lines' else 'lines'}", F.explode(every).alias(f"at_{other}"))

    l, r = dealt(left, "lines"), dealt(right, "columns")
    grid = ["at_lines", "at_columns"]
    met = full_outer(along(l, "columns"), along(r, "lines"), ks, vs, null_ks, also_on=grid, how="inner")

    def alone(df: DataFrame, side: str) -> DataFrame:
        mine = side[0]
        values = [
            F.col(v).alias(f"{mark}{v[1:]}") if mark == mine
            else F.lit(None).cast(df.schema[v].dataType).alias(f"{mark}{v[1:]}")
            for v in vs for mark in "lr"
        ]
        return df.where("not (in_left and in_right)").select(*ks, *values, F.lit(side).alias("side"))

    cold = full_outer(
        left.join(hot, on, "left_anti"), right.join(hot, on, "left_anti"), ks, vs, null_ks
    )
    return cold.unionByName(met).unionByName(alone(l, "left_only")).unionByName(alone(r, "right_only"))
