"""Leaving equal rows behind before whole rows are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.plans.joining import full_outer
from tablecheck.plans.keys import broadcast_measured, null_safe
from tablecheck.session import pin


def row_digest(vs: Sequence[str], df: DataFrame) -> Column:
    """SHA-256 of all values of a row.

    Each value goes in with its length, or as a mark for null, so two rows have the same
    text only if they have the same values.
    """

    def part(v: str) -> Column:
        value = F.col(v)
        is_binary = df.schema[v].dataType.simpleString() == "binary"
        text = F.hex(value) if is_binary else value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(v) for v in vs]) if vs else F.lit(""), 256))


def only_changed(
    left: DataFrame, right: DataFrame, ks: Sequence[str], vs: Sequence[str],
    null_ks: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """Both sides without the rows that are the same on both, for unique keys.

    Keys and digests are shuffled instead of whole rows. The keys that are left go to a second
    scan: broadcast if they are few, else by a shuffled semi-join. Where most rows differ, if only
    by noise within the tolerance, nothing is gained.
    """
    digests = [
        df.select(*ks, row_digest(vs, df).alias("v0")) for df in (left, right)
    ]
    changed = pin(
        full_outer(*digests, ks, ["v0"], null_ks)
        .filter(~F.col("l0").eqNullSafe(F.col("r0")))
        .select(*[F.col(k).alias(f"h_{k}") for k in ks]),
        "changed",
    )
    changed = broadcast_measured(changed)
    on = null_safe([F.col(k) for k in ks], [F.col(f"h_{k}") for k in ks])
    return tuple(df.join(changed, on, "left_semi") for df in (left, right))
