"""The plans are the ones wanted, and the number of jobs stays small."""

from __future__ import annotations

import re

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

import tablecheck as tc
from workloads import queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def actions(spark, action):
    """How many Spark SQL executions ``action`` starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    result = action()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return result, store.executionsCount() - before


def test_unique_keys_take_one_full_outer_merge_join(spark):
    text = plan(queries.reconcile_rows(spark, SF))
    assert len(re.findall(r"SortMergeJoin .*FullOuter", text)) == 1
    assert text.count("Exchange hashpartitioning") == 2
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    # The only sorts are those of the join, after the exchange.
    assert len(re.findall(r"\bSort \[", text)) == 2
    assert not re.search(r"Exchange[^\n]*\n[^\n]*\bSort \[", text)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_query_uses_python_rows_or_cross_joins(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                "BroadcastNestedLoopJoin"):
        assert bad not in text, bad


def test_null_keys_on_both_sides_join_null_safe(spark):
    text = plan(queries.reconcile_null_keys(spark, SF))
    join = re.search(r"SortMergeJoin (.*) FullOuter", text).group(0)
    assert join.count("isnull") == 2
    assert "isnull" not in re.search(
        r"SortMergeJoin (.*) FullOuter", plan(queries.reconcile_rows(spark, SF))
    ).group(0)


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    for name, part in (("b_old", df), ("b_new", df.withColumn("o_custkey", F.lit(1)))):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        part.write.bucketBy(4, "o_orderkey").sortBy("o_orderkey").option(
            "path", str(tmp_path / name)
        ).saveAsTable(name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    result = tc.reconcile(spark.table("b_old"), spark.table("b_new"), ["o_orderkey"])
    assert "Exchange" not in plan(result.rows)
    assert result.rows.count() > 0
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name in ("b_old", "b_new"):
        spark.sql(f"DROP TABLE {name}")


def test_a_key_report_reads_only_keys(spark):
    text = plan(queries.one_sided_rows(spark, SF))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == {"o_orderkey:bigint"}
    text = plan(queries.duplicate_key_report(spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text
    assert "partial_count" in text


def test_value_columns_are_pruned(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    text = plan(tc.reconcile(df, df, ["o_orderkey"], value_cols=["o_totalprice"]).rows)
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == {
        "o_orderkey:bigint,o_totalprice:double"
    }


def test_date_range_reaches_the_scan_of_both_sides(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    result = tc.reconcile(
        df, df, ["o_orderkey"], date_cols=["o_orderdate"],
        date_range=("o_orderdate", "1996-01-01", "1996-12-31"),
    )
    assert plan(result.rows).count("GreaterThanOrEqual(o_orderdate,") == 2


def test_paired_copies_shuffle_once_when_written(spark):
    text = final_plan(queries.reconcile_duplicate_keys(spark, SF))
    assert text.count("Exchange hashpartitioning") == 1
    # Rows that met within the tolerance, written before, and the rows that were left then.
    assert text.count("FileScan") == 2 and "Join" not in text


def test_few_repeating_keys_are_broadcast(spark):
    text = plan(queries.reconcile_few_duplicates(spark, SF))
    # For the keys that do not repeat; those that do were split off before they were paired.
    assert text.count("BroadcastHashJoin") == 2
    assert len(re.findall(r"SortMergeJoin .*FullOuter", text)) == 1


def test_tokenising_needs_no_shuffle(spark):
    assert "Exchange" not in plan(queries.tokenize_pages(spark, SF))
    text = plan(queries.restore_pages(spark, SF))
    # The lookup table is a constant by now, not parsed for every row.
    assert "Exchange" not in text and "from_json" not in text and "element_at" in text
    text = plan(tc.term_dictionary(spark.read.parquet(f"{SF}/pages.parquet"), "html"))
    after, before = text.split("Exchange")
    # Terms are distinct before they are hashed and before they move.
    assert "HashAggregate" in before and "sha2" not in before


def test_one_pass_per_count(spark):
    text = plan(queries.mismatch_counts(spark, SF))
    assert len(re.findall(r"SortMergeJoin", text)) == 1
    text = plan(queries.unparsed_dates(spark, SF))
    assert text.count("FileScan") == 1


def test_declared_unique_keys_are_counted_without_a_shuffle(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    seen = []
    original = DataFrame.collect
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrame, "collect", lambda df: seen.append(plan(df)) or original(df))
        tc.reconcile(df, df, ["o_orderkey"], unique_keys=True)
    assert len(seen) == 1 and "hashpartitioning" not in seen[0]
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", seen[0])) == {"o_orderkey:bigint"}


def test_a_whole_check_takes_few_actions(spark, tmp_path):
    left = spark.read.parquet(f"{SF}/orders.parquet")
    right = left.withColumn("o_totalprice", F.col("o_totalprice") + 1)

    def check():
        with pytest.raises(AssertionError):
            tc.reconcile(left, right, ["o_orderkey"]).assert_equal(str(tmp_path / "r"))

    _, n = actions(spark, check)
    # Key profile, comparison, totals, report.
    assert n <= 4
    _, n = actions(spark, lambda: tc.reconcile(left, left, ["o_orderkey"]).assert_equal())
    # Key profile, comparison, totals.
    assert n <= 3
