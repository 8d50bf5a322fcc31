"""Proportional stratified interleaving into shards.

Rows are shuffled by a seeded hash and ranked within their source. Sorted by fractional
rank, (rank + 1/2) / rows of the source, every stretch of the order has the mixture of the
whole, so it is cut into shards of equal counts. No ranking needs all rows of a source, or
all rows, in one task: ranks are taken in ranges of the hash and of the fractional rank, both
spread evenly, and the counts of the ranges before are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.llm.helpers import fresh, named
from tablecheck.session import pin

#: Rows that a range should hold.
RANGE_ROWS = 50_000


def interleave(
    df: DataFrame, n_shards: int, *, seed: int = 0, id_col: str = "doc_id",
    source_col: str = "source", tie_cols: tuple[str, ...] = (), shard_col: str = "shard",
    slot_col: str = "slot", range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``df`` with the shard of each row and its place there, counted from 0.

    The shuffled order is that of md5("seed:id"), then the id, then ``tie_cols``; null ids
    count as an empty text, and rows equal in all of these are interchangeable. A null
    source is a source. Shards hold the same number of rows, or differ by one; some are
    empty if there are fewer rows than shards. Existing columns called ``shard_col`` or
    ``slot_col`` are replaced. ``df`` is written to the scratch folder once: pass the
    columns that matter.
    """
    df = df.drop(shard_col, slot_col)
    key, stratum, part, frac = fresh(df, "key", "stratum", "part", "frac")
    text_id = F.coalesce(named(id_col).cast("string"), F.lit(""))
    source = named(source_col).cast("string")
    rows = pin(
        df.withColumn(key, F.md5(F.concat(F.lit(f"{seed}:"), text_id).cast("binary")))
        .withColumn(stratum, F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))),
        "shuffled",
    )
    total = rows.count()
    ranges = max(1, -(-total // range_rows))
    # Equal widths of the first 32 bits of the hash.
    lead = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    rows = rows.withColumn(part, F.floor(lead * ranges / F.lit(float(2**32))).cast("long"))
    sizes = rows.groupBy(stratum, part).agg(F.count("*").alias("n"))
    by_source = Window.partitionBy(stratum)
    earlier = by_source.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before, of = fresh(rows, "before", "of")
    sizes = sizes.select(
        stratum, part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before),
        F.sum("n").over(by_source).alias(of),
    )
    order = [F.col(key), named(id_col), *[named(c) for c in tie_cols]]
    inside = F.row_number().over(Window.partitionBy(stratum, part).orderBy(*order)) - 1
    ranked = (
        rows.withColumn(frac, inside).join(sizes, [stratum, part])
        .withColumn(frac, (2 * (F.col(frac) + F.col(before)) + 1) / (2 * F.col(of)).cast("double"))
        .withColumn(part, F.floor(F.col(frac) * ranges).cast("long")).drop(before, of)
    )
    ranked = pin(ranked, "ranked")
    counts = ranked.groupBy(part).agg(F.count("*").alias("n"))
    # One row for each range of about range_rows rows.
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(frac, stratum, *order)) - 1
    n, rows_in_all = F.lit(n_shards).cast("long"), F.lit(max(total, 1)).cast("long")
    place = (F.col(before) + F.col(frac)).cast("long")
    shard = F.expr(f"`{before}` * {n_shards} div {max(total, 1)}")
    return (
        ranked.withColumn(frac, inside).join(counts, part).withColumn(before, place)
        .withColumn(shard_col, shard.cast("int"))
        .withColumn(slot_col, F.col(before) - F.ceil(F.col(shard_col) * rows_in_all / n).cast("long"))
        .drop(key, stratum, part, frac, before)
    )


def write_shards(
    df: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot",
    rows_per_file: int = 1_000_000,
) -> None:
    """Write interleaved rows as Parquet, one folder a shard.

    Stretches of ``rows_per_file`` slots stay together and in order, so a task never holds a
    whole shard.
    """
    stretch = F.floor(named(slot_col) / rows_per_file)
    (
        df.repartition(named(shard_col), stretch).sortWithinPartitions(shard_col, slot_col)
        .write.mode("errorifexists").partitionBy(shard_col).parquet(path)
    )
