from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import tablecheck as tc
from tablecheck.functions import parse_date, render_date

DAY = dt.date(2024, 1, 31)


def test_dates_from_text(spark):
    given = ["20240131", "2024-01-31 10:11:12", "2024-01-31", "2024xx31", "31/01/2024", "202401", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, d string")
    out = [r["d"] for r in tc.standardize_dates(df, ["d"]).orderBy("i").collect()]
    assert out == [DAY, DAY, DAY, None, None, None, None]
    assert [tuple(r) for r in tc.unparsed_dates(df, ["d"]).collect()] == [("d", 3)]


def test_dates_from_other_types(spark):
    df = spark.sql(
        "SELECT 20240131 AS i, DATE'2024-01-31' AS d, TIMESTAMP'2024-01-31 23:59:59' AS t, "
        "TIMESTAMP_NTZ'2024-01-31 23:59:59' AS n"
    )
    out = tc.standardize_dates(df, ["i", "d", "t", "n"])
    assert tuple(out.first()) == (DAY,) * 4
    assert {f.dataType.simpleString() for f in out.schema} == {"date"}
    with pytest.raises(ValueError, match="no such date columns"):
        tc.standardize_dates(df, ["x"])


def test_range_on_each_type(spark):
    moments = ["2024-01-01 00:00:00", "2024-01-31 00:00:00", "2024-01-31 12:00:00", "2024-02-01 00:00:00"]
    df = spark.createDataFrame([(m,) for m in [*moments, None]], "m string").select(
        "m", F.col("m").cast("timestamp").alias("t"), F.col("m").cast("date").alias("d")
    )

    def kept(column, **options):
        return tc.in_date_range(df, column, "2024-01-01", "2024-01-31", **options).count()

    assert kept("m") == 3 and kept("d") == 3
    assert kept("t") == 2 and kept("t", as_date=True) == 3


def test_range_on_timestamps_is_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT id, TIMESTAMP'2024-01-01' + make_interval(0,0,0,id) AS t FROM range(50)").write.parquet(path)
    df = tc.in_date_range(spark.read.parquet(path), "t", "2024-01-05", "2024-01-09", as_date=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t," in plan and "LessThan(t," in plan
    assert df.count() == 5


def test_latest_date(spark):
    df = spark.createDataFrame([("20240131",), ("20231231",), ("bad",)], "c string")
    assert tc.latest_date(df, "c").first()["latest"] == "2024-01-31"
    assert tc.latest_date(df.limit(0), "c").first()["latest"] is None


def test_upper_names(spark):
    assert tc.upper_names(spark.range(1)).columns == ["ID"]


def test_render(spark):
    df = spark.createDataFrame([("20240131",)], "c string")
    value = render_date(parse_date(F.col("c"), df.schema["c"].dataType))
    assert df.select(value).first()[0] == "2024-01-31"
