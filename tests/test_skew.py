"""The plans for hot keys give what the plain plans give."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from itertools import product
from random import Random

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tablecheck as tc
from tablecheck import session
from tablecheck.plans import copies, folding, joining
from tablecheck.plans.digests import row_digest
from tablecheck.plans.folding import unfold
from tablecheck.plans.keys import broadcast_measured

SCHEMA = "k string, a int, b double"


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def hot_pair(spark):
    """Key ``h`` and the null key hold most rows; equal copies hold a third."""
    left = [("h", 1, 1.0)] * 30 + [("h", i % 7, float(i)) for i in range(25)]
    left += [(None, i % 3, None) for i in range(20)] + [(f"u{i}", i, 0.5) for i in range(10)]
    right = [("h", 1, 1.0)] * 17 + [("h", i % 5, float(i)) for i in range(28)]
    right += [(None, i % 4, 2.0) for i in range(11)] + [(f"u{i}", i, 0.5) for i in range(5, 12)]
    right += [("r", 1, 1.0)] * 9
    return spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)


def brute_force_pairs(left, right):
    """Equal copies cancel; the rest meets in value order within its key."""
    a, b = Counter(map(tuple, left.collect())), Counter(map(tuple, right.collect()))
    rest = {}
    for side, own, other in (("l", a, b), ("r", b, a)):
        for row, n in (own - other).items():
            rest.setdefault(row[0], {"l": [], "r": []})[side] += [row] * n

    def order(row):
        return [(v is not None, v) for v in row[1:]]

    out = Counter()
    for key, sides in rest.items():
        ls, rs = sorted(sides["l"], key=order), sorted(sides["r"], key=order)
        for i in range(max(len(ls), len(rs))):
            l = ls[i] if i < len(ls) else None
            r = rs[i] if i < len(rs) else None
            out[(key, l and l[1:], r and r[1:])] += 1
    return out


def as_pairs(df):
    out = Counter()
    for r in df.collect():
        l = None if r["_SIDE"] == "right_only" else (r["A_OLD"], r["B_OLD"])
        q = None if r["_SIDE"] == "left_only" else (r["A_NEW"], r["B_NEW"])
        out[(r["K"], l, q)] += 1
    return out


@pytest.mark.parametrize("hot_rows", [1_000_000, 5, 1])
def test_paired_copies_match_brute_force(hot_pair, hot_rows):
    result = tc.reconcile(*hot_pair, ["k"], strict_shape=False, hot_rows=hot_rows)
    assert as_pairs(result.rows) == brute_force_pairs(*hot_pair)


def test_a_copy_with_a_near_twin_is_no_mismatch(spark):
    schema = "k string, a double, b int"
    left = spark.createDataFrame([("x", 1.00001, 5), ("x", 1.0, 7)], schema)
    right = spark.createDataFrame([("x", 1.0, 5), ("x", 1.00001, 7)], schema)
    assert tc.reconcile(left, right, ["k"]).rows.count() == 0
    extra = left.union(spark.createDataFrame([("x", 0.5, 6), ("x", -3.0, 1)], schema))
    rows = tc.reconcile(extra, right, ["k"], strict_shape=False).rows.collect()
    assert sorted((r["A_OLD"], r["_SIDE"]) for r in rows) == [(-3.0, "left_only"), (0.5, "left_only")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from(["h", "u", None]), st.integers(0, 40), st.integers(0, 3)), max_size=30),
    st.randoms(use_true_random=False), st.sampled_from([2, 1000]),
)
def test_shuffled_copies_with_noise_agree(spark, rows, random, hot_rows):
    # Values a tolerance apart or more, moved by less than half of it.
    left = [(k, 0.01 * v + 0.005, b) for k, v, b in rows]
    right = [(k, v + random.uniform(-4e-5, 4e-5), b) for k, v, b in left]
    random.shuffle(right)
    schema = "k string, v double, b int"
    pair = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    assert tc.reconcile(*pair, ["k"], hot_rows=hot_rows).rows.count() == 0


def test_key_only_tables_with_repeated_keys(spark):
    left = spark.createDataFrame([("a",)] * 3 + [("b",)], "k string")
    right = spark.createDataFrame([("a",)] * 2 + [("b",)] * 2, "k string")
    rows = tc.reconcile(left, right, ["k"]).rows.collect()
    assert sorted(map(tuple, rows)) == [("a", "left_only"), ("b", "right_only")]


CELLS = st.tuples(
    st.sampled_from([None, "h", "h", "h", "u", "w"]), st.sampled_from([None, 1, 2]),
    st.sampled_from([None, 0.5, 1.5]),
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(CELLS, max_size=25), st.lists(CELLS, max_size=25), st.sampled_from([1, 3, 100]))
def test_any_tables_pair_like_brute_force(spark, left, right, hot_rows):
    pair = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    result = tc.reconcile(*pair, ["k"], strict_shape=False, hot_rows=hot_rows)
    # No two values are within the tolerance, so every pair that is left differs.
    assert as_pairs(result.rows) == brute_force_pairs(*pair)


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_cancelled_copies_come_back_with_keep_equal(hot_pair, hot_rows):
    left, right = hot_pair
    rows = tc.reconcile(
        left, right, ["k"], strict_shape=False, keep_equal=True, hot_rows=hot_rows
    ).rows
    seen_left = Counter((r["K"], r["A_OLD"], r["B_OLD"]) for r in rows.filter("_SIDE <> 'right_only'").collect())
    seen_right = Counter((r["K"], r["A_NEW"], r["B_NEW"]) for r in rows.filter("_SIDE <> 'left_only'").collect())
    assert seen_left == bag(left) and seen_right == bag(right)


@pytest.mark.parametrize("hot_rows", [1_000_000, 40, 5, 1])
def test_fanout_matches_brute_force(hot_pair, hot_rows):
    left, right = hot_pair
    result = tc.reconcile(
        left, right, ["k"], strict_shape=False, on_duplicates="fanout", keep_equal=True,
        max_fanout=100, hot_rows=hot_rows,
    )
    ls, rs = left.collect(), right.collect()
    want = Counter(
        (l["k"], tuple(l)[1:], tuple(r)[1:]) for l, r in product(ls, rs) if l["k"] == r["k"]
    )
    keys_left, keys_right = {l["k"] for l in ls}, {r["k"] for r in rs}
    want.update((l["k"], tuple(l)[1:], None) for l in ls if l["k"] not in keys_right)
    want.update((r["k"], None, tuple(r)[1:]) for r in rs if r["k"] not in keys_left)
    assert as_pairs(result.rows) == want


def test_few_repeating_keys_are_handled_apart(spark, monkeypatch):
    left = [(f"u{i}", i, 1.0) for i in range(100)] + [("d", 1, 1.0), ("d", 2, 2.0), (None, 1, 1.0)]
    right = [(f"u{i}", i, 1.0) for i in range(1, 101)] + [("d", 3, 1.0), ("d", 2, 2.0), (None, 1, 1.5)]
    pair = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    result = tc.reconcile(*pair, ["k"])
    assert result.profile.few_repeat and result.profile.repeated_keys == 1
    got = as_pairs(result.rows)
    assert got == {
        ("u0", (0, 1.0), None): 1, ("u100", None, (100, 1.0)): 1,
        ("d", (1, 1.0), (3, 1.0)): 1, (None, (1, 1.0), (1, 1.5)): 1,
    }
    assert as_pairs(tc.reconcile(*pair, ["k"], digest_first=True).rows) == got
    monkeypatch.setattr("tablecheck.plans.keys.FEW_ROWS", 0.0)
    again = tc.reconcile(*pair, ["k"])
    assert not again.profile.few_repeat and as_pairs(again.rows) == got
    # 99 unique keys on both sides and 2 on one, 2 pairs under "d", 1 under null.
    assert tc.reconcile(*pair, ["k"], keep_equal=True).rows.count() == 104


@pytest.mark.parametrize("limit", [128 * 1024 * 1024, 2])
def test_digests_leave_only_changed_rows(spark, monkeypatch, limit):
    monkeypatch.setattr("tablecheck.plans.keys.BROADCAST_BYTES", limit)
    left = [(None, 1, 1.0), ("a", 1, None), ("b", None, 1.0), ("c", 1, 0.0), ("l", 1, 1.0), ("x", 2, 3.0)]
    right = [(None, 2, 1.0), ("a", 1, 1.0), ("b", None, 1.0), ("c", 1, -0.0), ("r", None, None), ("x", 2, 3.0)]
    pair = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    result = tc.reconcile(*pair, ["k"], digest_first=True)
    plain = tc.reconcile(*pair, ["k"])
    assert bag(result.rows) == bag(plain.rows)
    assert bag(result.mismatch_counts) == bag(plain.mismatch_counts)
    assert result.summary.first() == plain.summary.first()
    assert result.compared.count() == 5


def test_digests_tell_values_apart(spark):
    texts = spark.createDataFrame(
        [("1", "23"), ("12", "3"), (None, "123"), ("123", None), ("", "123"), ("-", "123"), ("3:123", "")],
        "v0 string, v1 string",
    )
    assert texts.select(row_digest(["v0", "v1"], texts)).distinct().count() == 7


def test_unfold_in_steps(spark, monkeypatch):
    monkeypatch.setattr(folding, "UNFOLD_STEP", 10)
    df = spark.createDataFrame([("a", 1), ("b", 10), ("c", 11), ("d", 35)], "k string, copies long")
    out = unfold(df, ["k"], 35)
    assert Counter(r["k"] for r in out.collect()) == {"a": 1, "b": 10, "c": 11, "d": 35}
    assert {r["nth"] for r in out.filter("k = 'd'").collect()} == set(range(1, 36))


def test_what_is_too_large_is_not_broadcast(spark, hot_pair, monkeypatch):
    want = as_pairs(tc.reconcile(*hot_pair, ["k"], strict_shape=False, hot_rows=5).rows)
    few = spark.createDataFrame([("x" * 100,)] * 3, "k string")
    monkeypatch.setattr("tablecheck.plans.keys.BROADCAST_BYTES", 1)
    assert broadcast_measured(few) is few
    assert as_pairs(tc.reconcile(*hot_pair, ["k"], strict_shape=False, hot_rows=5).rows) == want


def test_numbers_by_range_are_consecutive(spark):
    rows = [(i % 2, i // 2, 1 + i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, v int, copies long").repartition(3)
    out = copies._numbered_by_range(df, ["g"], ["v"], 7)
    assert out.columns == ["g", "v", "copies", "first"]
    for g in (0, 1):
        at = 0
        for r in sorted((r for r in out.collect() if r["g"] == g), key=lambda r: r["v"]):
            assert r["first"] == at
            at += r["copies"]


def most_pairs(left, right, tolerance):
    """The size of a maximum matching, by augmenting paths."""
    partner = {}

    def place(i, seen):
        for j, b in enumerate(right):
            if j not in seen and all(abs(x - y) < tolerance for x, y in zip(left[i], b)):
                seen.add(j)
                if j not in partner or place(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(left)))


def unmet(spark, left, right, names, **options):
    """Reported rows by key, of tables whose value columns are all compared by tolerance."""
    schema = "k string, " + ", ".join(f"{n} double" for n in names)
    pair = [spark.createDataFrame([(k, *v) for k, v in rows], schema) for rows in (left, right)]
    rows = tc.reconcile(*pair, ["k"], abs_tol=0.1, strict_shape=False, **options).rows
    return Counter(r["K"] for r in rows.collect())


def test_pairing_invents_no_differences(spark):
    left = [("a", (1.04, 5.0)), ("a", (1.045, 7.0))]
    right = [("a", (1.13, 5.0)), ("a", (1.12, 7.0))]
    assert unmet(spark, left, right, "ab") == {}
    left, right = [("a", (0.04,)), ("a", (0.30,))], [("a", (-5.0,)), ("a", (0.11,))]
    assert unmet(spark, left, right, "a") == {"a": 1}


@pytest.mark.parametrize("width, missed", [(1, 0), (2, 2)])
def test_near_copies_meet_as_often_as_they_can(spark, width, missed):
    random = Random(width)
    tables = {}
    for g in range(60):
        draw = lambda: tuple(round(random.uniform(0, 0.9 / width), 3) for _ in range(width))
        tables[str(g)] = [[draw() for _ in range(random.randint(2, 9))] for _ in "lr"]
    sides = [[(k, v) for k, both in tables.items() for v in both[i]] for i in (0, 1)]
    reported = unmet(spark, *sides, "ab"[:width])
    for k, (l, r) in tables.items():
        # Pairs that do not agree take one row for two, so the longer side counts.
        least = max(len(l), len(r)) - most_pairs(l, r, 0.1)
        assert least <= reported[k] <= least + missed


def test_decimals_and_texts_meet_by_their_own_difference(spark):
    left = [("a", Decimal("1.0000"), "0012"), ("a", Decimal("2.0000"), "7")]
    right = [("a", Decimal("1.0001"), "12"), ("a", Decimal("2.0000"), "7.00001")]
    schema = "k string, d decimal(18,4), t string"
    pair = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    rows = tc.reconcile(*pair, ["k"], numeric_cols=["*"]).rows.collect()
    assert [(r["T_OLD"], r["T_NEW"], r["D_COMPARE"]) for r in rows] == [("0012", "12", False)]


def logged_pairs(monkeypatch, log):
    """Every call of the Python search writes its number of groups to ``log``."""
    plain = copies._best_pairs

    def logging(tolerance):
        search = plain(tolerance)

        def of_batch(groups: pa.Array) -> pa.Array:
            with open(log, "a") as f:
                f.write(f"{len(groups)}\n")
            return search(groups)

        return of_batch

    monkeypatch.setattr(copies, "_best_pairs", logging)
    return lambda: sum(map(int, log.read_text().split())) if log.exists() else 0


def test_only_groups_with_several_rows_of_a_side_are_searched_once(spark, tmp_path, monkeypatch):
    searched = logged_pairs(monkeypatch, tmp_path / "log")
    # Two rows a key; the whole number tells them apart, so each has one candidate.
    left = spark.range(400).selectExpr("id div 2 AS k", "id % 2 AS line", "id * 1.0D AS a")
    right = left.selectExpr("k", "line", "a + IF(k % 3 = 0, 0.5D, 0.00001D) AS a")
    reported = tc.reconcile(left, right, ["k"]).rows.collect()
    assert {r["K"] for r in reported} == {str(k) for k in range(0, 200, 3)}
    assert len(reported) == 2 * 67 and searched() == 0
    # Without it, a key's two rows and two candidates are searched, and once.
    reported = tc.reconcile(left.drop("line"), right.drop("line"), ["k"]).rows.collect()
    assert len(reported) == 2 * 67 and searched() == 200


def test_single_rows_meet_with_their_copies(spark):
    left = [("a", 1.0, "x")] * 5 + [("b", float("nan"), "x")] * 2 + [("c", 1.0, "x")] * 2
    right = [("a", 1.00001, "x")] * 3 + [("b", float("nan"), "x")] + [("c", 1.00001, "y")] * 2
    schema = "k string, a double, s string"
    pair = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    rows = tc.reconcile(*pair, ["k"], strict_shape=False, keep_equal=True).rows.collect()
    kinds = Counter((r["K"], r["_SIDE"], r["A_COMPARE"], r["S_COMPARE"]) for r in rows)
    assert kinds == {
        ("a", "both", True, True): 3, ("a", "left_only", False, False): 2,
        ("b", "both", True, True): 1, ("b", "left_only", False, False): 1,
        ("c", "both", True, False): 2,
    }


def test_equal_copies_are_kept_without_reading_the_inputs_again(spark, tmp_path):
    at = str(tmp_path / "left")
    spark.range(300).selectExpr("id % 100 AS k", "id * 1.0D AS a").write.parquet(at)
    left = spark.read.parquet(at)
    right = left.selectExpr("k", "IF(a < 90, a + 0.5D, a) AS a")
    rows = tc.reconcile(left, right, ["k"], keep_equal=True).rows
    assert rows.count() == 300
    assert not [f for f in rows.inputFiles() if at in f]


def test_a_hot_key_of_near_values_is_cut_into_stretches(spark, monkeypatch):
    random = Random(5)
    values = [round(0.013 * i, 6) for i in range(600)]
    left = [("h", (v,)) for v in values]
    right = [("h", (v + random.uniform(-0.05, 0.05),)) for v in values]
    sizes = []
    plain = copies._matched

    def spy(rows, group, *rest):
        sizes.extend(r["count"] for r in rows.groupBy(*group).count().collect())
        return plain(rows, group, *rest)

    monkeypatch.setattr(copies, "_matched", spy)
    reported = unmet(spark, left, right, "a", hot_rows=50)["h"]
    assert len(sizes) >= 24 and max(sizes) <= 50
    # Only rows within a tolerance of a cut may miss their twin: 8 rows a side at 24 cuts.
    assert reported <= 24 * 8 / 2


def test_counts_of_equal_copies_are_never_listed(spark):
    many = 10**12
    rows = [("k", True, 1, many), ("k", True, 2, 5), ("k", False, 1, 3), ("k", False, 3, many)]
    folded = spark.createDataFrame(rows, "k0 string, from_left boolean, v0 int, copies long")
    out = copies.pair_in_order(folded, ["k0"], ["v0"], ["v0"], 2 * many, 10**11)
    pairs = Counter()
    for r in out.collect():
        pairs[r["l0"], r["r0"], r["side"]] += r["copies"]
    assert pairs == {
        (1, 1, "both"): 3, (1, 3, "both"): many - 3, (2, 3, "both"): 3, (2, None, "left_only"): 2,
    }


def test_nothing_is_written_before_rows_are_asked_for(hot_pair):
    before = len(session._scratch)
    result = tc.reconcile(*hot_pair, ["k"], strict_shape=False)
    assert result.duplicate_keys.count() > 0
    result.null_counts.collect()
    result.schema_diff.collect()
    assert len(session._scratch) == before
    result.rows.count()
    assert len(session._scratch) > before


def test_hot_keys_of_both_sides_are_dealt_over_a_grid(spark):
    left = spark.range(400).selectExpr("id % 2 AS k", "id AS a")
    right = spark.range(300).selectExpr("id % 3 AS k", "id + 1000 AS a")
    result = tc.reconcile(
        left, right, ["k"], strict_shape=False, on_duplicates="fanout", keep_equal=True, hot_rows=10
    )
    rows = result.rows
    assert rows.filter("_SIDE = 'both'").count() == 2 * 200 * 100
    assert rows.filter("_SIDE = 'right_only'").count() == 100
    assert rows.distinct().count() == rows.count()
    # Cells of 10 pairs for each of 10 rows, dealt by hash: no line or column is far off.
    plan = result.compared._jdf.queryExecution().toString()
    assert "at_lines" in plan and "at_columns" in plan
    cells = fan_out_cells(left, right, 10)
    assert max(cells.values()) <= 4 * 100


def fan_out_cells(left, right, hot_rows):
    """Pairs by cell of the grid, recomputed from the joined rows of the plan."""
    seen = []
    plain = joining.full_outer

    def spy(l, r, ks, vs, null_ks, also_on=(), how="full"):
        if also_on:
            keys = [*ks, *also_on]
            met = l.groupBy(*keys).agg(F.count("*").alias("nl")).join(
                r.groupBy(*keys).agg(F.count("*").alias("nr")), keys
            )
            seen.extend(met.select(*keys, (F.col("nl") * F.col("nr")).alias("n")).collect())
        return plain(l, r, ks, vs, null_ks, also_on, how)

    joining.full_outer = spy
    try:
        joining.fan_out(
            left.selectExpr("k AS k0", "a AS v0"), right.selectExpr("k AS k0", "a AS v0"),
            ["k0"], ["v0"], [], 200, hot_rows,
        )
    finally:
        joining.full_outer = plain
    return {tuple(r)[:-1]: r["n"] for r in seen}
