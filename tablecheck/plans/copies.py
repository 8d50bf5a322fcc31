"""Pairing the copies of a repeated key one to one.

Copies that are the same in every column cancel out, counted rather than listed. Of what is
left, rows that agree within the tolerance meet first. The rest is numbered within its key in
value order, and the n-th left copy meets the n-th right copy. The result never has more rows
than both inputs together. Equal copies stay one row with a count until a pair is reported.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.functions.compare import approx_equal
from tablecheck.plans.folding import fold, unfold
from tablecheck.plans.keys import broadcast_measured, key_counts, null_safe
from tablecheck.session import pin, stored

# Rows of one key and the same exact values that one task matches at a time.
MATCHED_ROWS = 100_000
PAIRS = "array<struct<l: int, r: int, n: bigint>>"


@dataclass(frozen=True)
class Twins:
    """Values that are compared within ``tolerance``: the columns ``near``.

    ``patterns`` gives, for text columns among them, what reads as a number. ``whole`` are
    whole numbers, which a tolerance of up to 1 leaves equal or not; they are ordered with
    the near ones.
    """

    tolerance: float
    near: tuple[str, ...]
    patterns: Mapping[str, str] = field(default_factory=dict)
    whole: tuple[str, ...] = ()

    def number(self, v: str) -> Column:
        """The value as a finite double; null if it is only equal to itself."""
        double = F.col(v).try_cast("double")
        finite = F.abs(double) < F.lit(float("inf"))
        if v in self.patterns:
            finite &= F.col(v).rlike(self.patterns[v])
        return F.when(finite, double)

    def exact(self, v: str) -> Column:
        """What rows that may meet have in common: null for every number."""
        return F.when(self.number(v).isNull(), F.coalesce(F.col(v).cast("string"), F.lit("")))


def _numbered(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Folded rows with ``first``, the copies of the group that come before them."""
    window = Window.partitionBy(*group).orderBy(*(order or [F.lit(0)]))
    upto = F.sum("copies").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("first", (upto - F.col("copies")).cast("bigint"))


def _numbered_by_range(
    df: DataFrame, group: Sequence[str], order: Sequence[str], parts: int
) -> DataFrame:
    """The same numbers for groups too large for one task.

    A range partitioning on (group, order) cuts a large group into consecutive parts. The
    parts are pinned, numbered apart, and shifted by the copies of the group that lie in
    earlier parts.
    """
    ranged = df.repartitionByRange(parts, *group, *order).withColumn("part", F.spark_partition_id())
    pinned = pin(ranged, "ranges")
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        pinned.groupBy(*group, "part")
        .agg(F.sum("copies").alias("n"))
        .withColumn("shift", F.sum("n").over(before))
        .filter("shift > 0")
        .select(*[F.col(g).alias(f"s_{g}") for g in group], F.col("part").alias("s_part"), "shift")
    )
    # A part can only begin in the middle of one group, so there are at most as many
    # shifts as parts.
    on = null_safe([F.col(g) for g in group], [F.col(f"s_{g}") for g in group])
    on &= F.col("part") == F.col("s_part")
    local = _numbered(pinned, [*group, "part"], order)
    shifted = F.col("first") + F.coalesce(F.col("shift"), F.lit(0))
    return local.join(broadcast_measured(pin(shifts, "shifts")), on, "left").select(
        *df.columns, shifted.alias("first")
    )


def _split_hot(
    folded: DataFrame, group: Sequence[str], limit: int
) -> tuple[DataFrame, DataFrame, int] | None:
    """The rows of groups with up to, and of those with more than, ``limit`` folded rows, and
    how many the latter are; None if there are none."""
    hot = pin(
        folded.groupBy(*group)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > limit)
        .select(*[F.col(g).alias(f"h_{g}") for g in group], "n"),
        "hot-keys",
    )
    rows = hot.agg(F.sum("n")).first()[0]
    if rows is None:
        return None
    hot = broadcast_measured(hot.drop("n"))
    on = null_safe([F.col(g) for g in group], [F.col(f"h_{g}") for g in group])
    return folded.join(hot, on, "left_anti"), folded.join(hot, on, "left_semi"), rows


def pair_in_order(
    folded: DataFrame, ks: Sequence[str], vs: Sequence[str], order: Sequence[str],
    max_copies: int, hot_rows: int,
) -> DataFrame:
    """The n-th left copy beside the n-th right copy of a key, in ``order``: ``full_outer`` rows
    with their number of ``copies``.

    ``folded`` is ``(keys, from_left, values, copies)``. Each row covers an interval of the
    numbers of its side, and overlapping intervals meet, so that equal copies are never listed.
    Up to ``hot_rows`` rows of a key are one task's; larger groups are numbered in ranges, and
    numbers are paired in stretches of ``hot_rows``.
    """
    group = [*ks, "from_left"]
    split = None
    if max_copies > hot_rows:
        folded = pin(folded, "surplus")
        split = _split_hot(folded, group, hot_rows)
    if split is None:
        numbered = _numbered(folded.repartition(*ks), group, order)
    else:
        cold, hot, rows = split
        # About hot_rows rows per part, however many there are.
        ranged = _numbered_by_range(hot, group, order, -(-rows // hot_rows) + 1)
        numbered = _numbered(cold, group, order).unionByName(ranged)
    return _overlaps(numbered, ks, vs, hot_rows if max_copies > hot_rows else None)


def _overlaps(
    numbered: DataFrame, ks: Sequence[str], vs: Sequence[str], stretch: int | None
) -> DataFrame:
    """Pairs of a left and a right row whose intervals ``[first, first + copies)`` overlap.

    Both ends of every interval are marks on a line; between two marks, the last interval
    that began on each side is the one that covers, unless it has ended.
    """
    end = F.col("first") + F.col("copies")
    at = [*ks]
    if stretch is not None:
        places = F.sequence(F.floor(F.col("first") / stretch), F.floor((end - 1) / stretch))
        numbered = numbered.withColumn("end", end).withColumn("place", F.explode(places))
        begin = F.greatest(F.col("first"), F.col("place") * stretch)
        end = F.least(F.col("end"), (F.col("place") + 1) * stretch)
        at = [*ks, "place"]
        numbered = numbered.withColumn("first", begin).withColumn("copies", end - begin)
        numbered = numbered.repartition(*at)
        end = F.col("first") + F.col("copies")
    row = F.struct(end.cast("bigint").alias("end"), *vs)
    nothing = F.lit(None).cast("boolean")
    marks = F.array(
        F.struct(F.col("first").cast("bigint").alias("mark"), F.col("from_left").alias("starts")),
        F.struct(end.cast("bigint").alias("mark"), nothing.alias("starts")),
    )
    marks = numbered.select(*at, row.alias("row"), F.inline(marks)).groupBy(*at, "mark").agg(
        F.max(F.when(F.col("starts"), F.col("row"))).alias("l"),
        F.max(F.when(~F.col("starts"), F.col("row"))).alias("r"),
    )
    along = Window.partitionBy(*at).orderBy("mark")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = marks.select(
        *at, "mark", F.lead("mark").over(along).alias("next"),
        *[F.last(mark, ignorenulls=True).over(so_far).alias(mark) for mark in "lr"],
    ).where("next is not null")
    here = {mark: F.coalesce(F.col(f"{mark}.end") > F.col("mark"), F.lit(False)) for mark in "lr"}
    side = (
        F.when(here["l"] & here["r"], "both").when(here["l"], "left_only")
        .when(here["r"], "right_only")
    )
    values = [
        F.when(here[mark], F.col(f"{mark}.{v}")).alias(f"{mark}{v[1:]}") for v in vs for mark in "lr"
    ]
    return covered.select(
        *ks, *values, side.alias("side"), (F.col("next") - F.col("mark")).alias("copies")
    ).where("side is not null")


def _best_pairs(tolerance: float) -> Callable:
    """A function that pairs the rows of each group: lists of each near column's values and of
    copies, of both sides, give ``(left place, right place, copies)``, null where there is none.
    """

    def numbers(column):
        return [Decimal(x.strip()) if isinstance(x, str) else x for x in column]

    def within(a, b):
        # As columns are compared: the difference in their own type, then as a double.
        return abs(float(a - b)) < tolerance

    def cells(column):
        return len({float(x) // tolerance for x in column})

    def pairs(left_copies, right_copies, *columns):
        left_n, right_n = list(left_copies), list(right_copies)
        width = len(columns) // 2
        out = []
        if left_n and right_n:
            # Columns without a number hold None on both sides and always agree.
            columns = [(numbers(columns[i]), numbers(columns[width + i])) for i in range(width)
                       if columns[i][0] is not None]
            # The column that tells most rows apart leads.
            if len(columns) > 1:
                columns.sort(key=lambda sides: -cells(sides[0] + sides[1]))
            (lead_l, lead_r), *others = columns or [([0.0] * len(left_n), [0.0] * len(right_n))]
            lefts = sorted(range(len(left_n)), key=lead_l.__getitem__)
            rights = sorted(range(len(right_n)), key=lead_r.__getitem__)
            waiting, taken = [], 0
            for i in lefts:
                while taken < len(rights) and (
                    lead_r[rights[taken]] <= lead_l[i] or within(lead_l[i], lead_r[rights[taken]])
                ):
                    waiting.append(rights[taken])
                    taken += 1
                # The leads only grow: what is too small now stays so.
                small = 0
                while small < len(waiting) and not within(lead_l[i], lead_r[waiting[small]]):
                    small += 1
                del waiting[:small]
                place = 0
                while left_n[i] and place < len(waiting):
                    j = waiting[place]
                    if all(within(l[i], r[j]) for l, r in others):
                        n = min(left_n[i], right_n[j])
                        out.append((i, j, n))
                        left_n[i] -= n
                        right_n[j] -= n
                    if right_n[j]:
                        place += 1
                    else:
                        del waiting[place]
        out += [(i, None, n) for i, n in enumerate(left_n) if n]
        return out + [(None, j, n) for j, n in enumerate(right_n) if n]

    # Whole batches become Python lists at once, which costs less than a call for each group.
    def of_batch(groups: pa.Array) -> pa.Array:
        lists = groups.flatten()
        values = [a.values.to_pylist() for a in lists]
        cuts = [a.offsets.to_pylist() for a in lists]
        found, ends = [], [0]
        for g in range(len(groups)):
            found += pairs(*[v[c[g] : c[g + 1]] for v, c in zip(values, cuts)])
            ends.append(len(found))
        l, r, n = zip(*found) if found else ((), (), ())
        rows = pa.StructArray.from_arrays(
            [pa.array(l, pa.int32()), pa.array(r, pa.int32()), pa.array(n, pa.int64())],
            names=["l", "r", "n"],
        )
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return of_batch


def _marked(
    rows: DataFrame, ks: Sequence[str], vs: Sequence[str], twins: Twins
) -> tuple[DataFrame, list[str]]:
    """``rows`` with the exact values of near columns, and what rows that may meet share."""
    marks = {v: f"x{v}" for v in twins.near}
    marked = rows.select("*", *[twins.exact(v).alias(x) for v, x in marks.items()])
    return marked, [*ks, *[v for v in vs if v not in twins.near], *marks.values()]


def pair_near(
    surplus: DataFrame, ks: Sequence[str], vs: Sequence[str], twins: Twins, max_copies: int,
    hot_rows: int,
) -> tuple[DataFrame, DataFrame]:
    """Pairs of rows that agree within the tolerance, and the rows that are left.

    Rows with the same exact values are gathered by key. With one near column the smallest
    left row meets the smallest right row it can, which gives as many pairs as there can be;
    with several this is done along the column that varies most, and may miss some. A
    group of more than MATCHED_ROWS folded rows (``hot_rows`` if that is less) is cut into
    stretches of that size in value order, and what is left in a second round at other places:
    there a row close to a cut may miss its twin.
    """
    limit = min(hot_rows, MATCHED_ROWS)
    rows, group = _marked(surplus, ks, vs, twins)
    if max_copies <= limit:
        return _matched(rows, group, ks, vs, twins)
    rows = pin(rows, "surplus")
    split = _split_hot(rows, group, limit)
    if split is None:
        return _matched(rows, group, ks, vs, twins)
    cold, hot, n = split
    met, left = _matched(cold, group, ks, vs, twins)
    places = [f"o{v}" for v in twins.near]
    for turn in (0, 1):
        ordered = hot.select("*", *[twins.number(v).alias(o) for v, o in zip(twins.near, places)])
        # Rows are numbered here, not copies: each counts once.
        ordered = ordered.withColumnRenamed("copies", "each").withColumn(
            "copies", F.lit(1).cast("bigint")
        )
        order = [*places, "from_left", *twins.near]
        ordered = _numbered_by_range(ordered, group, order, -(-n // limit) + 1)
        stretch = F.floor((F.col("first") + F.lit(turn * (limit // 2))) / limit)
        cut = ordered.drop("copies", *places).withColumnRenamed("each", "copies")
        found, hot = _matched(
            cut.withColumn("stretch", stretch).drop("first"), [*group, "stretch"], ks, vs, twins
        )
        met = met.unionByName(found)
        hot = _marked(hot, ks, vs, twins)[0]
    return met, left.unionByName(hot.select(left.columns))


def _matched(
    rows: DataFrame, group: Sequence[str], ks: Sequence[str], vs: Sequence[str], twins: Twins
) -> tuple[DataFrame, DataFrame]:
    """``pair_near`` for groups that a task can hold."""
    return _met_and_left(_sorted_out(rows, group, vs, twins), ks, vs, twins)


def _sorted_out(
    rows: DataFrame, group: Sequence[str], vs: Sequence[str], twins: Twins
) -> DataFrame:
    """``_single_pairs``, written, and beside the rows of ``many`` what the search made of them."""
    first = _single_pairs(rows, group, vs, twins)
    read = rows.sparkSession.read.schema(first.schema)
    path = stored(first, "surplus")
    searched = _searched(read.parquet(path).where("many"), group, vs, twins)
    return read.parquet(path, stored(searched, "twins"))


def _single_pairs(
    rows: DataFrame, group: Sequence[str], vs: Sequence[str], twins: Twins
) -> DataFrame:
    """``rows`` with ``met``, the copies that meet the only row of the other side, ``other``,
    where a group has one row of each side; ``many`` where it has more rows of one and any of
    the other, which take a search.

    Most groups have one side or one row of each, and these need no list and no Python.
    """
    all_rows = Window.partitionBy(*group)
    row = F.struct(*twins.near, "copies")
    mine = F.col("from_left")

    def only(side: Column, name: str) -> list[Column]:
        return [
            F.count_if(side).over(all_rows).alias(f"n_{name}"),
            F.first(F.when(side, row), ignorenulls=True).over(all_rows).alias(f"one_{name}"),
        ]

    seen = rows.select("*", *only(mine, "l"), *only(~mine, "r"))
    single = (F.col("n_l") == 1) & (F.col("n_r") == 1)
    close = reduce(and_, [
        F.col(f"x{v}").isNotNull() | approx_equal(
            F.col(f"one_l.{v}"), F.col(f"one_r.{v}"), rows.schema[v].dataType, twins.tolerance,
            twins.patterns.get(v),
        )
        for v in twins.near
    ])
    met = F.when(
        mine.isNotNull() & single & close, F.least("one_l.copies", "one_r.copies")
    ).otherwise(F.lit(0).cast("bigint"))
    return seen.withColumn("met", met).select(
        *rows.columns, "met",
        F.when(mine & (F.col("met") > 0), F.col("one_r")).alias("other"),
        (mine.isNotNull() & ~single & (F.col("n_l") > 0) & (F.col("n_r") > 0)).alias("many"),
    )


def _met_and_left(
    rows: DataFrame, ks: Sequence[str], vs: Sequence[str], twins: Twins
) -> tuple[DataFrame, DataFrame]:
    """From ``_sorted_out`` rows: ``full_outer`` rows of what meets, and what is left."""

    def value(v: str, mark: str) -> Column:
        return F.col(f"other.{v}" if mark == "r" and v in twins.near else v).alias(f"{mark}{v[1:]}")

    done = rows.where(~F.col("many"))
    met = done.where(F.col("from_left") & (F.col("met") > 0)).select(
        *ks, *[value(v, mark) for v in vs for mark in "lr"],
        F.lit("both").alias("side"), F.col("met").alias("copies"),
    )
    left = done.where(F.col("copies") > F.col("met")).select(
        *ks, "from_left", *vs, (F.col("copies") - F.col("met")).alias("copies")
    )
    return met, left


def _searched(
    rows: DataFrame, group: Sequence[str], vs: Sequence[str], twins: Twins
) -> DataFrame:
    """Groups with several rows of a side: a row as in ``_single_pairs`` for each pair, and for
    each row, or rest of its copies, that found none."""
    row = F.struct(*twins.near, "copies")
    mine = F.col("from_left")
    grouped = rows.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.when(mine, row))).alias("ls"),
        F.sort_array(F.collect_list(F.when(~mine, row))).alias("rs"),
    )

    def column(v: str, side: str) -> Column:
        floating = rows.schema[v].dataType.typeName() in ("float", "double")
        kind = "double" if floating else "string"
        return F.when(
            F.col(f"x{v}").isNull(), F.transform(side, lambda x: x[v].cast(kind))
        ).otherwise(F.transform(side, lambda x: F.lit(None).cast(kind)))

    best = F.arrow_udf(_best_pairs(twins.tolerance), PAIRS)
    lists = [F.col("ls.copies"), F.col("rs.copies")]
    lists += [column(v, side) for side in ("ls", "rs") for v in twins.near]
    pairs = best(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(lists)]))
    # Outer, as Spark would else filter on the pairs first, and so make them twice.
    found = grouped.withColumn("pairs", pairs).select("*", F.inline_outer("pairs"))
    found = found.select(
        *group, F.get("ls", F.col("l")).alias("l"), F.get("rs", F.col("r")).alias("r"), "n"
    )
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    made = {
        **{v: F.when(F.col("l").isNull(), F.col(f"r.{v}")).otherwise(F.col(f"l.{v}")) for v in twins.near},
        "from_left": F.col("l").isNotNull(), "copies": F.col("n"),
        "met": F.when(both, F.col("n")).otherwise(F.lit(0).cast("bigint")),
        "other": F.when(both, F.col("r")), "many": F.lit(False),
        "equal": F.lit(0).cast("bigint"),
    }
    return found.select(*[made.get(c, F.col(c)).alias(c) for c in rows.columns])


def pair_copies(
    left: DataFrame, right: DataFrame, ks: Sequence[str], vs: Sequence[str],
    max_copies: int, hot_rows: int, twins: Twins = Twins(0.0, ()), keep_equal: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The paired remainder, as ``full_outer`` rows, and the rows that cancelled out.

    The second frame is ``(keys, values, copies)``. Whole rows are shuffled for the counts;
    what did not cancel is shuffled again, first to the rows within the tolerance, where
    values may differ within one, then in value order. Without a hot key the first shuffle
    is by key and serves the rows within the tolerance too. ``keep_equal`` says that the
    second frame will be read: it is then written with what did not cancel.
    """
    near = twins.tolerance > 0 and bool(twins.near)
    by_key = near and max_copies <= min(hot_rows, MATCHED_ROWS)
    folded = fold(left, right, ks, vs, by_key)
    n_left, n_right = F.col("n_left"), F.col("n_right")
    equal = F.least(n_left, n_right)
    surplus = folded.select(
        *ks, *vs, F.when(n_left != n_right, n_left > n_right).alias("from_left"),
        F.abs(n_left - n_right).alias("copies"), equal.alias("equal"),
    )
    if by_key and keep_equal:
        marked, group = _marked(surplus, ks, vs, twins)
        cancelled = _sorted_out(marked, group, vs, twins)
        met, surplus = _met_and_left(cancelled, ks, vs, twins)
    else:
        cancelled, met = surplus, None
        surplus = surplus.where("from_left IS NOT NULL").drop("equal")
        if near:
            met, surplus = pair_near(surplus, ks, vs, twins, max_copies, hot_rows)
    cancelled = cancelled.where("equal > 0").select(*ks, *vs, F.col("equal").alias("copies"))
    # Exactly compared values first, so that near ones cannot reorder the others.
    last = {*twins.near, *twins.whole}
    order = [v for v in vs if v not in last] + [v for v in vs if v in last]
    paired = pair_in_order(surplus, ks, vs, order, max_copies, hot_rows)
    paired = paired if met is None else met.unionByName(paired)
    names = [c for c in paired.columns if c != "copies"]
    return unfold(paired, names, max_copies).drop("nth"), cancelled


def split_by_repetition(
    left: DataFrame, right: DataFrame, ks: Sequence[str]
) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Both sides without, and with only, the keys that repeat on either side.

    For tables in which few rows have such keys. The keys are broadcast if they are small.
    """
    repeated = key_counts(left, right, ks).filter("n_left > 1 OR n_right > 1")
    repeated = pin(repeated.select(*[F.col(k).alias(f"h_{k}") for k in ks]), "repeated")
    repeated = broadcast_measured(repeated)
    on = null_safe([F.col(k) for k in ks], [F.col(f"h_{k}") for k in ks])

    def part(df: DataFrame, how: str) -> DataFrame:
        return df.join(repeated, on, how)

    return (
        (part(left, "left_anti"), part(right, "left_anti")),
        (part(left, "left_semi"), part(right, "left_semi")),
    )
