"""Key statistics that decide how two tables are joined."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is split over several tasks.
HOT_ROWS = 1_000_000
# Share of all rows up to which the rows of repeating keys are handled apart.
FEW_ROWS = 0.1


# What may be broadcast, measured before it is.
BROADCAST_BYTES = 128 * 1024 * 1024


def broadcast_measured(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its values take at most BROADCAST_BYTES.

    For pinned tables of few rows, whose keys may still be long. A larger one is left
    unmarked, and Spark joins it by shuffling.
    """
    width = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns]
    size = df.agg(F.sum(reduce(add, width)).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def null_safe(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(and_, [a.eqNullSafe(b) for a, b in zip(left, right)])


def key_counts(left: DataFrame, right: DataFrame, ks: Sequence[str]) -> DataFrame:
    """``(keys, n_left, n_right)``: one shuffle of the keys alone, counted before it."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    tagged = left.select(*ks, one.alias("l"), none.alias("r")).unionByName(
        right.select(*ks, none.alias("l"), one.alias("r"))
    )
    return tagged.groupBy(*ks).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


@dataclass(frozen=True)
class KeyProfile:
    rows_left: int
    rows_right: int
    sampled_left: int
    sampled_right: int
    duplicated_left: int
    duplicated_right: int
    repeated_keys: int
    repeated_rows: int
    max_copies: int
    pairs: int
    null_counts: tuple[tuple[int, int], ...]

    def keys_null_on_both_sides(self, ks: Sequence[str]) -> list[str]:
        return [k for k, (left, right) in zip(ks, self.null_counts) if left and right]

    @property
    def few_repeat(self) -> bool:
        """Whether the repeating keys hold few of all rows."""
        return self.repeated_rows <= (self.sampled_left + self.sampled_right) * FEW_ROWS


def profile_keys(
    left: DataFrame, right: DataFrame, ks: Sequence[str], sampled: Column | None = None
) -> KeyProfile:
    """All counts a comparison needs, from one job that reads only the key columns.

    ``sampled`` is a predicate on the keys; duplicates and pairs are counted among the
    keys it keeps, totals and nulls among all.
    """
    kept = F.lit(True) if sampled is None else sampled
    n_left, n_right = F.col("n_left"), F.col("n_right")
    repeats = kept & ((n_left > 1) | (n_right > 1))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0).cast("bigint"))

    pairs = F.sum(F.when(kept, n_left.cast("decimal(19,0)") * n_right))
    row = (
        key_counts(left, right, ks)
        .agg(
            total(n_left).alias("rows_left"),
            total(n_right).alias("rows_right"),
            total(F.when(kept, n_left)).alias("sampled_left"),
            total(F.when(kept, n_right)).alias("sampled_right"),
            F.count_if(kept & (n_left > 1)).alias("duplicated_left"),
            F.count_if(kept & (n_right > 1)).alias("duplicated_right"),
            F.count_if(repeats).alias("repeated_keys"),
            total(F.when(repeats, n_left + n_right)).alias("repeated_rows"),
            F.coalesce(F.max(F.when(kept, F.greatest(n_left, n_right))), F.lit(0)).alias("copies"),
            F.coalesce(pairs, F.lit(0)).alias("pairs"),
            *[total(F.when(F.col(k).isNull(), n_left)).alias(f"nulls_left_{k}") for k in ks],
            *[total(F.when(F.col(k).isNull(), n_right)).alias(f"nulls_right_{k}") for k in ks],
        )
        .first()
    )
    return KeyProfile(
        rows_left=row["rows_left"],
        rows_right=row["rows_right"],
        sampled_left=row["sampled_left"],
        sampled_right=row["sampled_right"],
        duplicated_left=row["duplicated_left"],
        duplicated_right=row["duplicated_right"],
        repeated_keys=row["repeated_keys"],
        repeated_rows=row["repeated_rows"],
        max_copies=row["copies"],
        pairs=int(row["pairs"]),
        null_counts=tuple((row[f"nulls_left_{k}"], row[f"nulls_right_{k}"]) for k in ks),
    )


def count_unique_keys(
    left: DataFrame, right: DataFrame, ks: Sequence[str], sampled: Column | None = None
) -> KeyProfile:
    """What ``profile_keys`` gives for keys known to be unique, without moving a key."""
    kept = F.lit(True) if sampled is None else sampled

    def counts(df: DataFrame, side: str) -> DataFrame:
        return df.agg(
            F.lit(side).alias("side"), F.count("*").alias("n"), F.count_if(kept).alias("sampled"),
            *[F.count_if(F.col(k).isNull()).alias(f"nulls_{k}") for k in ks],
        )

    both = counts(left, "l").unionByName(counts(right, "r"))
    l, r = sorted(both.collect(), key=lambda row: row["side"])
    return KeyProfile(
        rows_left=l["n"],
        rows_right=r["n"],
        sampled_left=l["sampled"],
        sampled_right=r["sampled"],
        duplicated_left=0,
        duplicated_right=0,
        repeated_keys=0,
        repeated_rows=0,
        max_copies=1,
        pairs=min(l["sampled"], r["sampled"]),
        null_counts=tuple((l[f"nulls_{k}"], r[f"nulls_{k}"]) for k in ks),
    )
