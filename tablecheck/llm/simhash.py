"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt to tiles by population count, and the tiles of a crowded
count further by a hash. Two fingerprints that differ in at most ``radius`` bits differ by
at most that much in population count, so a pair of tiles meets in a task only if its
counts do. In the task each side is sorted by the population counts of four quarters of
the bits and cut into runs; runs whose quarters differ by more than the radius in sum are
skipped, the others are compared whole by exclusive-or and bit count. A task returns
a spanning forest of the links it finds, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.llm.components import components
from tablecheck.llm.helpers import fresh, named, offsets
from tablecheck.session import pin

SEED = 42
TILE = 65_536
RUN = 512
#: Shingles that are counted together.
BLOCK_SHINGLES = 1_000_000


def _spread() -> np.ndarray:
    """For each byte its eight bits, each in a byte of a 64-bit integer."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8").ravel()


def bits_over_half(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``counts`` hashes; an empty run has zero."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    # Runs are cut to 255 hashes at most, so that sums fit the bytes of the spread bits.
    size = counts[some]
    pieces = -(-size // 255)
    first = np.repeat(offsets(size), pieces)
    at = first + 255 * (np.arange(pieces.sum()) - np.repeat(offsets(pieces), pieces))
    owner, spread = offsets(pieces), _spread()
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        sums = np.add.reduceat(spread[lanes[:, byte]], at)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
        on = 2 * ones > size[:, None]
        weights = np.uint64(1) << np.arange(8 * byte, 8 * byte + 8, dtype=np.uint64)
        out[some] |= (on * weights).sum(axis=1, dtype=np.uint64)
    return out


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of the shingles of ``width`` words, repeats included."""
    words = (text or "").encode().lower().split()  # both only touch ASCII
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - width + 1].tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]


def fingerprint_column(text: Column, width: int) -> Column:
    """SimHash of ``text`` as a signed long with the 64 bits; no words give zero.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; shingles are
    ``width`` words joined by a blank, hashed by XXH64 with seed 42.
    """

    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, hashes, counts, size = [], [], [], 0
            for value in batch:
                found = shingle_hashes(value.as_py(), width)
                hashes.append(np.array(found, np.uint64))
                counts.append(len(found))
                size += len(found)
                if size > BLOCK_SHINGLES:
                    out.append(bits_over_half(np.concatenate(hashes), np.array(counts)))
                    hashes, counts, size = [], [], 0
            if counts:
                out.append(bits_over_half(np.concatenate(hashes), np.array(counts)))
            bits = np.concatenate(out) if out else np.array([], np.uint64)
            yield pa.array(bits.view(np.int64))

    return F.arrow_udf(fingerprints, T.LongType())(text)


def forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking positions a and b: the least position each one reaches."""
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped
        if np.array_equal(labels, before):
            return labels


def quarters(prints: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters."""
    return np.bitwise_count(prints.view("<u2").reshape(-1, 4)).astype(np.int16)


def compare_tiles(one: np.ndarray, other: np.ndarray | None, radius: int) -> tuple:
    """Spanning links between two tiles (within one if ``other`` is None).

    Returns two arrays of fingerprints: each linked one and the representative it reaches.
    """
    def sorted_runs(prints):
        count = quarters(prints)
        order = np.lexsort(count.T)
        prints, count = prints[order], count[order]
        at = np.arange(0, len(prints), RUN)
        return prints, at, np.minimum.reduceat(count, at), np.maximum.reduceat(count, at)

    a, a_at, a_low, a_high = sorted_runs(one)
    b, b_at, b_low, b_high = sorted_runs(one if other is None else other)
    nodes = a if other is None else np.concatenate([a, b])
    shift = 0 if other is None else len(a)
    labels = np.arange(len(nodes))
    for i, start in enumerate(a_at.tolist()):
        gap = np.maximum(0, np.maximum(a_low[i] - b_high, b_low - a_high[i])).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        if other is None:
            near = near[near >= i]
        mine = a[start : start + RUN]
        left, right = [], []
        for j in near.tolist():
            theirs = b[b_at[j] : b_at[j] + RUN]
            hits = np.bitwise_count(mine[:, None] ^ theirs[None, :]) <= radius
            x, y = np.nonzero(hits)
            left.append(x + start)
            right.append(y + b_at[j] + shift)
        if left:
            x, y = np.concatenate(left), np.concatenate(right)
            apart = labels[x] != labels[y]
            if apart.any():
                labels = forest(labels, x[apart], y[apart])
    linked = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[linked], nodes[labels[linked]]


def links(prints: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Spanning links (a, b) of the distinct longs in ``prints.fp`` within ``radius`` bits."""
    counted = prints.select("fp", F.bit_count("fp").cast("int").alias("ones"))
    # At most 65 rows: how many fingerprints have each population count.
    sizes = {r["ones"]: r["n"] for r in counted.groupBy("ones").agg(F.count("*").alias("n")).collect()}
    tiles = {ones: -(-n // tile) for ones, n in sizes.items()}
    if not tiles:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    per = F.create_map(*[F.lit(x) for pair in sorted(tiles.items()) for x in pair])
    me = counted.select(
        "fp", "ones", F.pmod(F.xxhash64("fp"), per[F.col("ones")]).cast("int").alias("part")
    )
    reach = F.array(*[F.lit(d) for d in range(-radius, radius + 1)])
    meets = (
        me.withColumn("with", F.explode(F.transform(reach, lambda d: F.col("ones") + d)))
        .where(F.array_contains(F.array(*[F.lit(o) for o in sorted(tiles)]), F.col("with")))
        .withColumn("part2", F.explode(F.sequence(F.lit(0), (per[F.col("with")] - 1).cast("int"))))
    )
    mine, yours = F.struct("ones", "part"), F.struct(F.col("with").alias("ones"), F.col("part2").alias("part"))
    first = mine <= yours
    cells = meets.select(
        F.when(first, mine).otherwise(yours).alias("low"),
        F.when(first, yours).otherwise(mine).alias("high"),
        (~first).alias("second"), "fp",
    )

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy().view(np.uint64)
        if key[0].as_py() == key[1].as_py():
            a, b = compare_tiles(fp, None, radius)
        else:
            second = table["second"].to_numpy()
            one, other = fp[~second], fp[second]
            if not len(one) or not len(other):
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            a, b = compare_tiles(one, other, radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return cells.groupBy("low", "high").applyInArrow(compare, "a long, b long")


def near_duplicates(
    df: DataFrame, *, width: int = 4, radius: int = 4, id_col: str = "doc_id",
    text_col: str = "text", tile: int = TILE,
) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints (see ``fingerprint_column``) link at ``radius`` or fewer differing bits;
    the component of a document is the least id it reaches over links. Equal texts and
    repeated rows share a fingerprint and so a component. Null and empty texts have
    fingerprint zero, which links like any other. Null ids take part, and a component of
    nothing but null ids has a null component_id. An empty table gives no rows. Other
    columns of ``df`` do not matter and are not returned.

    Every pair of distinct fingerprints that population counts cannot tell apart is
    compared, so work grows with the square of their number, divided by what counts skip.
    """
    prints = pin(
        df.select(named(id_col).alias("doc_id"), fingerprint_column(named(text_col), width).alias("fp")),
        "fingerprints",
    )
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(firsts.select("fp"), radius, tile))
    labelled = firsts.join(roots, firsts["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    # A fingerprint of very many documents is one row on this side.
    known = labelled.join(least, "root").select("fp", "component_id")
    return prints.join(known, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(df: DataFrame, *, width: int = 4, radius: int = 4, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without those whose component has a lesser document.

    The least id of each component stays. A repeated id goes as one: all its rows, if any of
    them has a lesser partner. Rows without an id cannot be told apart and stay.
    """
    found = near_duplicates(df, width=width, radius=radius, id_col=id_col, text_col=text_col)
    (gone,) = fresh(df, "gone")
    rejected = found.where("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return df.join(rejected, named(id_col) == F.col(gone), "left_anti")
