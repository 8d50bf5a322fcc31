from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import tablecheck as tc


def test_key_sample_follows_the_key_alone(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("part"))
    want = {
        i for i in range(2000) if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 10_000 < 1000
    }
    sample = tc.sample_rows(df, ["id"], tc.Sample(0.1))
    assert {r["id"] for r in sample.collect()} == want
    moved = tc.sample_rows(df.repartition(7).orderBy(F.desc("id")), ["id"], tc.Sample(0.1))
    assert {r["id"] for r in moved.collect()} == want


def test_row_sample_is_what_sample_by_gives(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("part"))
    want = df.sampleBy("part", {0: 0.1, 1: 0.1, 2: 0.1}, 42)
    got = tc.sample_rows(df, ["id"], tc.Sample(0.1, method="row"))
    assert [r["id"] for r in got.collect()] == [r["id"] for r in want.collect()]


def test_strata_include_null(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("s"))
    got = {r["stratum"]: (r["rows"], r["sampled"]) for r in tc.strata(df, "s", ["id"], 0.2).collect()}
    assert set(got) == {None, "1", "2", "3"}
    assert all(rows == 250 and 25 < sampled < 80 for rows, sampled in got.values())


def test_sample_of_the_comparison_is_the_comparison_of_the_samples(spark, rows):
    left = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    right = left.withColumn("v", F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("v")))
    sample = tc.Sample(0.3)
    inside = tc.reconcile(left, right, ["id"], sample=sample)
    apart = tc.reconcile(*[tc.sample_rows(d, ["id"], sample) for d in (left, right)], ["id"])
    assert rows(inside.rows) == rows(apart.rows)
    totals = inside.summary.first()
    assert totals["rows_left"] == 1000 and inside.profile.sampled_left < 400


def test_sample_needs_equal_counts(spark):
    left = spark.range(10).select("id", F.col("id").alias("v"))
    with pytest.raises(ValueError, match="different shapes"):
        tc.reconcile(left, left.limit(9), ["id"], sample=0.5)
    tc.reconcile(left, left, ["id"], sample=0.5).assert_equal()
    tc.reconcile(left, left, ["id"], sample=tc.Sample(0.5, "row")).assert_equal()
    tc.reconcile(left, left.repartition(7), ["id"], sample=tc.Sample(0.5, "row")).assert_equal()
    with pytest.raises(ValueError, match="fraction"):
        tc.Sample(1.5)
    with pytest.raises(ValueError, match="method"):
        tc.Sample(0.5, "other")
