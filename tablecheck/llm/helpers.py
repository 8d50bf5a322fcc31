"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``, which ``bytes.split()`` follows too.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(*columns: Column) -> Column:
    """64 bits that tell rows apart which share an id but not their text."""
    return F.xxhash64(*columns)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
    """The runs ``flat[starts[c]:starts[c] + lengths[c]]`` of all codes, one after another."""
    sizes = lengths[codes]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return flat[:0]
    shift = np.repeat(starts[codes] - (ends - sizes), sizes)
    return flat[shift + np.arange(total)]


def offsets(lengths: Sequence[int] | np.ndarray) -> np.ndarray:
    """Where each of consecutive runs of these lengths starts."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return ends - lengths
