from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import tablecheck as tc

SCHEMA = "k string, v double"
NAN, INF = float("nan"), float("inf")
LEFT = [
    (None, 2.0), ("k1", 1.0), ("k2", NAN), ("k3", INF), ("k4", 5.0), ("k5", 1.0), ("k6", 1.0),
    ("k7", None), ("lo", None),
]
RIGHT = [
    (None, 2.0), ("k1", 1.0), ("k2", NAN), ("k3", INF), ("k4", 5.0001), ("k5", 1.5), ("k6", None),
    ("k7", None), ("ro", None),
]


@pytest.fixture
def pair(spark):
    return spark.createDataFrame(LEFT, SCHEMA), spark.createDataFrame(RIGHT, SCHEMA)


def test_comparison_rules(pair):
    result = tc.reconcile(*pair, ["k"], keep_equal=True)
    got = {r["K"]: (r["V_COMPARE"], r["_SIDE"]) for r in result.rows.collect()}
    assert got == {
        None: (True, "both"), "k1": (True, "both"), "k2": (True, "both"), "k3": (True, "both"),
        "k4": (True, "both"), "k5": (False, "both"), "k6": (False, "both"), "k7": (True, "both"),
        "lo": (True, "left_only"), "ro": (True, "right_only"),
    }


def test_mismatches_summary_and_counts(pair, rows):
    result = tc.reconcile(*pair, ["k"])
    assert rows(result.rows, "K") == [("k5",), ("k6",), ("lo",), ("ro",)]
    assert result.rows.columns == ["K", "V_OLD", "V_NEW", "V_COMPARE", "_SIDE"]
    assert rows(result.mismatch_counts) == [("V_COMPARE", 2)]
    assert rows(result.null_counts) == [("K", "_NEW", 1), ("K", "_OLD", 1)]
    assert result.summary.first().asDict() == {
        "rows_left": 9, "rows_right": 9, "left_only": 1, "right_only": 1, "mismatched_rows": 4,
        "schema_differences": 0, "verdict": "different",
    }


def test_assert_equal(pair, spark, tmp_path):
    left, right = pair
    assert tc.reconcile(left, left, ["k"]).assert_equal()["verdict"] == "identical"
    report = str(tmp_path / "report")
    with pytest.raises(AssertionError, match="4 rows differ.*'V_COMPARE': 2"):
        tc.reconcile(left, right, ["k"]).assert_equal(report)
    assert spark.read.csv(report, header=True).count() == 4


def test_verdict_does_not_depend_on_keep_equal(pair):
    left, _ = pair
    result = tc.reconcile(left, left, ["k"], keep_equal=True)
    assert result.rows.count() == len(LEFT)
    result.assert_equal()
    assert result.pin().summary.first()["verdict"] == "identical"


def test_tolerance_is_strict_but_equal_numbers_always_agree(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "k int, v double")
    right = spark.createDataFrame([(1, 1.0), (2, 1.5), (3, 1.25)], "k int, v double")

    def differing(tolerance):
        return {r["K"] for r in tc.reconcile(left, right, ["k"], abs_tol=tolerance).rows.collect()}

    assert differing(0.0) == {"2", "3"}
    assert differing(0.25) == {"2", "3"}
    assert differing(0.5) == {"2"}
    assert differing(0.51) == set()


def test_large_integers_and_decimals_keep_every_digit(spark):
    big = 2**53
    schema = "k int, n long, d decimal(38,2)"
    left = [(1, big + 1, Decimal("123456789012345678901234567890.01")), (2, -(2**63), Decimal(0))]
    right = [(1, big, Decimal("123456789012345678901234567890.02")), (2, 0, Decimal(0))]
    result = tc.reconcile(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"]
    )
    got = {r["K"]: (r["N_COMPARE"], r["D_COMPARE"]) for r in result.rows.collect()}
    assert got == {"1": (False, False), "2": (False, True)}
    assert tc.reconcile(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"],
        value_cols=["d"], abs_tol=0.011,
    ).rows.count() == 0


def test_text_dates_and_booleans_are_compared_exactly(spark):
    schema = "k int, t string, d date, b boolean"
    day = dt.date(2024, 1, 31)
    left = spark.createDataFrame([(1, "x", day, True), (2, None, None, None)], schema)
    right = spark.createDataFrame([(1, "y", day, False), (2, None, None, None)], schema)
    only = tc.reconcile(left, right, ["k"]).rows.first()
    assert (only["T_COMPARE"], only["D_COMPARE"], only["B_COMPARE"]) == (False, True, False)
    # With numeric_only none of them is a number except the booleans.
    only = tc.reconcile(left, right, ["k"], numeric_only=True).rows.first()
    assert (only["T_COMPARE"], only["D_COMPARE"], only["B_COMPARE"]) == (True, True, False)
    assert only["T_OLD"] is None
    later = spark.sql("SELECT 1 AS k, TIMESTAMP'2024-01-31 00:00:01' AS t")
    sooner = spark.sql("SELECT 1 AS k, TIMESTAMP'2024-01-31 00:00:00' AS t")
    assert tc.reconcile(later, sooner, ["k"], numeric_only=True).rows.count() == 1
    assert tc.reconcile(later, sooner, ["k"], numeric_only=True, abs_tol=1.5).rows.count() == 0


def test_text_numbers(spark):
    schema = "k int, t string"
    left = spark.createDataFrame([(1, "1.0"), (2, "abc"), (3, "abc"), (4, None)], schema)
    right = spark.createDataFrame([(1, "1.00001"), (2, "abc"), (3, "abd"), (4, "1")], schema)
    assert tc.reconcile(left, right, ["k"]).rows.count() == 3
    tolerant = tc.reconcile(left, right, ["k"], numeric_cols=["T"]).rows
    assert {r["K"] for r in tolerant.collect()} == {"3", "4"}
    # Text on one side and numbers on the other are compared as numbers.
    numbers = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "k int, t double")
    mixed = tc.reconcile(left, numbers, ["k"]).rows
    assert {r["K"] for r in mixed.collect()} == {"2", "3"}


def test_keys_are_brought_to_a_common_type(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "k double, v string")
    assert tc.reconcile(left, right, ["k"]).rows.count() == 0
    text = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, v string")
    assert tc.reconcile(left, text, ["k"]).rows.count() == 0
    dates = spark.createDataFrame([(dt.date(2024, 1, 1), "a")] * 2, "k date, v string")
    with pytest.raises(ValueError, match="no common type"):
        tc.reconcile(left, dates, ["k"])


def test_flags_against_numbers(spark):
    left = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, b boolean")
    for kind in ("int", "double", "decimal(5,1)"):
        right = spark.sql(
            f"SELECT * FROM VALUES (1, CAST(1 AS {kind})), (2, CAST(1 AS {kind})), (3, NULL) AS t(k, b)"
        )
        assert [r["K"] for r in tc.reconcile(left, right, ["k"]).rows.collect()] == ["2"]


@pytest.mark.parametrize("kind", ["double", "float", "decimal(20,3)", "binary", "date", "timestamp", "boolean"])
def test_keys_of_any_type(spark, kind):
    made = {
        "double": "double('nan'), double('-0.0'), 1.5D", "float": "float('nan'), float('-0.0'), float(1.5)",
        "decimal(20,3)": "1.250BD, 0BD, -1BD", "binary": "X'00ff', X'', X'00'", "boolean": "true, false",
        "date": "DATE'2024-01-01', DATE'0001-01-01'", "timestamp": "TIMESTAMP'2024-01-01 00:00:00.000001', TIMESTAMP'2024-01-01 00:00:00.000002'",
    }[kind]
    df = spark.sql(f"SELECT explode(array({made}, NULL)) AS k, 1 AS v").select(
        F.col("k").cast(kind).alias("k"), "v"
    )
    assert tc.reconcile(df, df, ["k"], pin_inputs=True).rows.count() == 0
    assert tc.reconcile(df, df, ["k"], pin_inputs=True, digest_first=True).rows.count() == 0
    twice = df.union(df)
    changed = twice.withColumn("v", F.lit(2))
    assert tc.reconcile(twice, twice, ["k"], pin_inputs=True).rows.count() == 0
    assert tc.reconcile(twice, changed, ["k"], pin_inputs=True, hot_rows=1).rows.count() == twice.count()


def test_nested_values_are_rejected(spark):
    left = spark.createDataFrame([(1, [1])], "k int, v array<int>")
    with pytest.raises(ValueError, match="array<int> cannot be compared"):
        tc.reconcile(left, left, ["k"])


def test_names(spark):
    clash = spark.createDataFrame([(1, 2)], "a int, A int")
    with pytest.raises(ValueError, match="collide"):
        tc.reconcile(clash, clash, ["a"])
    odd = spark.createDataFrame(
        [(1, 1, 1, 1, 1, 1)], "`k.1` int, `A B` int, `A.B` int, A int, AB int, A_OLD int"
    )
    changed = odd.withColumn("A.B", F.lit(5))
    row = tc.reconcile(odd, changed, ["k.1"]).rows.first().asDict()
    assert list(row) == [
        "K.1", "A_OLD", "A_NEW", "A_COMPARE", "A B_OLD", "A B_NEW", "A B_COMPARE", "A.B_OLD",
        "A.B_NEW", "A.B_COMPARE", "AB_OLD", "AB_NEW", "AB_COMPARE", "A_OLD_OLD", "A_OLD_NEW",
        "A_OLD_COMPARE", "_SIDE",
    ]
    assert [n for n, v in row.items() if v is False] == ["A.B_COMPARE"]
    assert tc.reconcile(odd, changed, ["k.1"]).pin().rows.count() == 1
    with pytest.raises(ValueError, match="report column names collide"):
        tc.reconcile(odd, odd, ["A_OLD"])


def test_keys_only(spark, rows):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(2,), (3,)], "k int")
    result = tc.reconcile(left, right, ["k"])
    assert rows(result.rows) == [("1", "left_only"), ("3", "right_only")]
    assert rows(result.mismatch_counts) == []


def test_shape_gate(spark, rows):
    left = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int")
    short = spark.createDataFrame([(1, 1)], "k int, v int")
    other = spark.createDataFrame([(1, 1), (2, 2)], "k int, w int")
    with pytest.raises(ValueError, match="different shapes: 2 x 2.*1 x 2"):
        tc.reconcile(left, short, ["k"])
    with pytest.raises(ValueError, match=r"different columns: \['V', 'W'\]"):
        tc.reconcile(left, other, ["k"])
    assert rows(tc.reconcile(left, short, ["k"], strict_shape=False).rows, "K") == [("2",)]
    assert tc.reconcile(left, other, ["k"], strict_shape=False).rows.count() == 0
    with pytest.raises(ValueError, match="at least one key"):
        tc.reconcile(left, left, [])
    with pytest.raises(ValueError, match="missing on one side"):
        tc.reconcile(left, left, ["nope"])


def test_schema_difference_fails_the_assertion(spark, rows):
    left = spark.createDataFrame([(1, 1)], "k int, v int")
    right = spark.createDataFrame([(1, 1)], "k long, V long")
    result = tc.reconcile(left, right, ["k"])
    assert rows(result.schema_diff) == [("K", "int", "bigint"), ("V", "int", "bigint")]
    assert rows(tc.schema_diff(left, right)) == rows(result.schema_diff)
    with pytest.raises(AssertionError, match="schemas differ"):
        result.assert_equal()
    result.assert_equal(check_schema=False)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, v int")
    result = tc.reconcile(empty, empty, ["k"])
    assert result.summary.first()["verdict"] == "identical"
    assert [r["null_count"] for r in result.null_counts.collect()] == [0, 0]


def test_duplicates_pair_copies(spark, rows):
    left = spark.createDataFrame([("d", 1.0), ("d", 2.0), ("d", 2.0), ("e", 9.0)], SCHEMA)
    right = spark.createDataFrame([("d", 2.0), ("d", 2.0), ("d", 5.0), ("e", 9.0)], SCHEMA)
    assert tc.reconcile(left, left, ["k"]).rows.count() == 0
    result = tc.reconcile(left, right, ["k"])
    assert rows(result.rows) == [("d", 1.0, 5.0, False, "both")]
    everything = tc.reconcile(left, right, ["k"], keep_equal=True).rows
    assert everything.count() == 4
    assert rows(result.duplicate_keys) == [("d", 3, 3)]
    assert rows(tc.duplicate_keys(left, ["k"])) == [("d", 3)]


def test_duplicates_surplus_copies_are_one_sided(spark, rows):
    left = spark.createDataFrame([("d", 1.0)] * 5, SCHEMA)
    right = spark.createDataFrame([("d", 1.0)] * 2, SCHEMA)
    result = tc.reconcile(left, right, ["k"], strict_shape=False)
    assert rows(result.rows, "_SIDE") == [("left_only",)] * 3
    nulls = spark.createDataFrame([("d", None)] * 2, SCHEMA)
    result = tc.reconcile(left, nulls, ["k"], strict_shape=False, keep_equal=True)
    assert rows(result.rows, "_SIDE") == [("both",)] * 2 + [("left_only",)] * 3


def test_duplicates_fanout_and_error(spark):
    left = spark.createDataFrame([("d", 1.0), ("d", 2.0)], SCHEMA)
    result = tc.reconcile(left, left, ["k"], on_duplicates="fanout", keep_equal=True)
    assert sorted(r["V_COMPARE"] for r in result.rows.collect()) == [False, False, True, True]
    with pytest.raises(ValueError, match="keys repeat: 1 keys on the left, 1"):
        tc.reconcile(left, left, ["k"], on_duplicates="error")
    many = spark.createDataFrame([("d", float(i)) for i in range(20)], SCHEMA)
    with pytest.raises(ValueError, match="400 pairs"):
        tc.reconcile(many, many, ["k"], on_duplicates="fanout", max_fanout=4)
    every = tc.reconcile(many, many, ["k"], on_duplicates="fanout", keep_equal=True)
    assert every.rows.count() == 400
    with pytest.raises(ValueError, match="on_duplicates"):
        tc.reconcile(left, left, ["k"], on_duplicates="first")


def test_date_columns_and_range(spark, rows):
    schema = "k int, d string, v int"
    left = spark.createDataFrame(
        [(1, "20240101", 1), (2, "20240131", 1), (3, "20240201", 1), (4, None, 1)], schema
    )
    right = spark.createDataFrame(
        [(1, "2024-01-01", 1), (2, "2024-01-31 10:11:12", 2), (3, "2024-02-01", 9), (5, "?", 1)],
        schema,
    )
    result = tc.reconcile(
        left, right, ["k"], date_cols=["d"], date_range=("d", "2024-01-01", "2024-01-31")
    )
    assert rows(result.rows, "K", "D_COMPARE", "V_COMPARE") == [("2", True, False)]
    with pytest.raises(ValueError):
        tc.reconcile(left, right, ["k"], date_cols=["d"], date_range=("d", "01/01/2024", "x"))


def test_null_key_text_and_ordered_report(pair, spark, tmp_path):
    result = tc.reconcile(*pair, ["k"], keep_equal=True)
    assert "(none)" in {r["K"] for r in result.report(null_key_text="(none)").collect()}
    path = str(tmp_path / "ordered")
    assert result.write_report(path, ordered=True, single_file=True, null_key_text="(none)")
    keys = [r["K"] for r in spark.read.csv(path, header=True).coalesce(1).collect()]
    assert keys == sorted(keys, reverse=True)


def test_frames_in_one_call(pair, spark, tmp_path, capsys):
    path = str(tmp_path / "report")
    got = tc.assert_dataframes_approx_equal(
        *pair, index_columns=["k"], count_nulls=True, show_detailed_regression=True,
        output_path_name=path,
    )
    assert got.count() == 4 == spark.read.csv(path, header=True).count()
    out = capsys.readouterr().out
    assert "null keys in K_OLD: 1" in out and "V_COMPARE: 2" in out and path in out
    with pytest.raises(ValueError, match="different shapes"):
        tc.assert_dataframes_approx_equal(pair[0], pair[0].limit(1), index_columns=["k"])


def test_many_text_keys(spark, rows):
    schema = "a string, b string, c string, v int"
    left = [("x", None, "z", 1), (None, "x", "z", 2), ("x", "y", "z", 3), ("l", None, None, 4)]
    right = [("x", None, "z", 1), (None, "x", "z", 5), ("x", "y", "z", 3), (None, None, "r", 4)]
    result = tc.reconcile(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["a", "b", "c"]
    )
    assert rows(result.rows, "A", "B", "C", "_SIDE") == [
        ("l", None, None, "left_only"), (None, "x", "z", "both"), (None, None, "r", "right_only"),
    ]


def test_wide_tables(spark):
    columns = [f"c{i}" for i in range(600)]
    df = spark.range(3).select("id", *[F.lit(i).alias(c) for i, c in enumerate(columns)])
    changed = df.withColumn("c599", F.col("id"))
    result = tc.reconcile(df, changed, ["id"])
    assert result.rows.count() == 3 and len(result.rows.columns) == 1 + 3 * 600 + 1


def test_declared_unique_keys(pair, rows):
    plain, declared = tc.reconcile(*pair, ["k"]), tc.reconcile(*pair, ["k"], unique_keys=True)
    assert rows(declared.rows) == rows(plain.rows)
    assert rows(declared.null_counts) == rows(plain.null_counts)
    assert declared.summary.first() == plain.summary.first()
    with pytest.raises(ValueError, match="different shapes"):
        tc.reconcile(pair[0], pair[1].limit(2), ["k"], unique_keys=True)


def test_pinned_inputs_are_computed_once(spark):
    left = spark.range(200).select("id", F.rand().alias("v"))
    fickle = left.filter(F.rand() < 0.5)
    result = tc.reconcile(left, fickle, ["id"], strict_shape=False, pin_inputs=True, keep_equal=True)
    kept = result.rows.filter("_SIDE = 'both'").count()
    assert kept == result.profile.rows_right == result.rows.filter("V_NEW IS NOT NULL").count()
    assert result.rows.collect() == result.rows.collect()
