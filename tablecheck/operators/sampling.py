"""Samples that agree on both sides of a comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.functions.columns import column

# Key hashes fall into this many buckets; the seed of row sampling.
BUCKETS = 10_000
SEED = 42


@dataclass(frozen=True)
class Sample:
    """``method="key"`` keeps the rows whose key hashes low, so both sides keep the same
    keys however they are stored. ``method="row"`` draws rows at random, as
    ``DataFrame.sampleBy`` does when every stratum has the same fraction; ``reconcile`` draws
    them on the left and keeps the keys drawn on both sides.
    """

    fraction: float = 0.10
    method: str = "key"

    def __post_init__(self) -> None:
        if not 0 < self.fraction <= 1:
            raise ValueError("sample fraction must be in (0, 1]")
        if self.method not in ("key", "row"):
            raise ValueError("sample method must be 'key' or 'row'")


def key_in_sample(keys: Sequence[Column], fraction: float) -> Column:
    """Whether a key belongs to the sample: a filter, no shuffle and no strata list."""
    text = F.concat_ws("\u0001", *[k.cast("string") for k in keys])
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % BUCKETS
    return bucket < F.lit(fraction * BUCKETS)


def sample_rows(df: DataFrame, keys: Sequence[str], sample: Sample) -> DataFrame:
    if sample.method == "row":
        return df.filter(F.rand(SEED) < sample.fraction)
    return df.filter(key_in_sample([column(k) for k in keys], sample.fraction))


def strata(df: DataFrame, by: str, keys: Sequence[str], fraction: float) -> DataFrame:
    """``(stratum, rows, sampled)`` for every value of ``by``; null is a stratum too."""
    chosen = key_in_sample([column(k) for k in keys], fraction)
    return df.groupBy(column(by).cast("string").alias("stratum")).agg(
        F.count("*").alias("rows"), F.count_if(chosen).alias("sampled")
    )
