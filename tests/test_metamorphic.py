"""Relations that hold between runs on changed inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import tablecheck as tc
from workloads.snapshots import new_lines, new_orders, old_lines, old_orders

SF = "/root/testdata/sf0.001"
KEY = ["o_orderkey"]
LINE_KEY = ["l_orderkey", "l_linenumber"]


@pytest.fixture(scope="module")
def orders(spark):
    return old_orders(spark, SF), new_orders(spark, SF)


@pytest.fixture(scope="module")
def lines(spark):
    return old_lines(spark, SF), new_lines(spark, SF)


def test_a_table_agrees_with_itself(orders, lines):
    assert tc.reconcile(orders[0], orders[0], KEY).rows.isEmpty()
    assert tc.reconcile(lines[0], lines[0], LINE_KEY).rows.isEmpty()


@pytest.mark.parametrize("table", ["orders", "lines"])
def test_swapping_sides_swaps_suffixes(request, rows, table):
    left, right = request.getfixturevalue(table)
    keys = KEY if table == "orders" else LINE_KEY
    there = tc.reconcile(left, right, keys).rows
    back = tc.reconcile(right, left, keys).rows
    swapped = {
        c: c.removesuffix("_OLD") + "_NEW" if c.endswith("_OLD") else
        c.removesuffix("_NEW") + "_OLD" if c.endswith("_NEW") else c
        for c in back.columns
    }
    other = {"left_only": "right_only", "right_only": "left_only", "both": "both"}
    side = F.create_map(*[F.lit(x) for pair in other.items() for x in pair])
    renamed = back.toDF(*[swapped[c] for c in back.columns]).withColumn("_SIDE", side[F.col("_SIDE")])
    assert rows(renamed.select(there.columns)) == rows(there)


def test_mismatches_never_grow_with_the_tolerance(orders):
    counts = [
        tc.reconcile(*orders, KEY, abs_tol=t).summary.first()["mismatched_rows"]
        for t in (0.0, 1e-6, 1e-4, 0.1)
    ]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1]


def test_partitioning_of_the_inputs_does_not_matter(orders, lines, rows):
    for (left, right), keys in ((orders, KEY), (lines, LINE_KEY)):
        want = rows(tc.reconcile(left, right, keys).rows)
        moved = tc.reconcile(left.repartition(5), right.repartition(3).orderBy(F.rand(1)), keys)
        assert rows(moved.rows) == want


def test_pinning_changes_nothing(orders, rows):
    result = tc.reconcile(*orders, KEY)
    pinned = result.pin()
    assert pinned.pin() is pinned
    assert rows(pinned.rows) == rows(result.rows)
    assert rows(pinned.mismatch_counts) == rows(result.mismatch_counts)
    assert pinned.summary.first() == result.summary.first()


def test_counts_and_rows_agree(lines):
    result = tc.reconcile(*lines, LINE_KEY)
    totals = result.summary.first()
    assert totals["mismatched_rows"] == result.rows.count()
    kept = tc.reconcile(*lines, LINE_KEY, keep_equal=True)
    both = kept.rows.groupBy("_SIDE").count().collect()
    by_side = {r["_SIDE"]: r["count"] for r in both}
    assert by_side["both"] + by_side["left_only"] == totals["rows_left"]
    assert by_side["both"] + by_side["right_only"] == totals["rows_right"]
