from __future__ import annotations

import json
import math
import re

import pytest

import tablecheck as tc
from tablecheck.session import pin, scratch_path

CSV = 'k;v;s\n1;;\n2;NaN;""\n3;abc;x\n'


def test_delimited_text(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(CSV)
    text = tc.read_table(spark, str(path), header=True)
    assert [tuple(r) for r in text.collect()] == [
        ("1", None, None), ("2", "NaN", None), ("3", "abc", "x"),
    ]
    typed = tc.read_table(spark, str(path), header=True, schema="k int, v double, s string").collect()
    assert typed[0]["v"] is None and typed[2]["v"] is None
    bare = tc.read_table(spark, str(path))
    assert bare.columns == ["_c0", "_c1", "_c2"] and bare.count() == 4
    inferred = tc.read_table(spark, str(path), header=True, infer_schema=True)
    assert inferred.schema["k"].dataType.simpleString() == "int"


def test_each_path_decides_its_own_format(spark, tmp_path):
    left, right = str(tmp_path / "l.csv"), str(tmp_path / "r.parquet")
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    df.write.option("header", True).csv(left, sep=";")
    df.replace(2.0, 2.5, "v").write.parquet(right)
    result = tc.reconcile_files(spark, left, right, ["k"], header=True)
    assert [r["K"] for r in result.rows.collect()] == ["2"]


def test_files_in_one_call(spark, tmp_path, capsys):
    a, b, c = (str(tmp_path / f"{n}.csv") for n in "abc")
    header = "dtCutOff;seg;amount\n"
    (tmp_path / "a.csv").write_text(header + "20240131;x;1.0\n20240229;y;2\n20240229;;3\n")
    (tmp_path / "b.csv").write_text(header + "2024-01-31;x;1.00001\n2024-02-29;y;2\n2024-02-29;;3\n")
    (tmp_path / "c.csv").write_text(header + "2024-01-31;x;1.5\n2024-02-29;y;2\n2024-02-29;;3\n")
    options = dict(
        header=True, index_columns=["dtCutOff", "seg"], date_columns=["dtcutoff"],
        suffixes=("_SQL", "_SPARK"), count_nulls=True, detailed_regression=True,
    )
    tc.assert_files_approx_equal(spark, a, b, **options)
    out = capsys.readouterr().out
    assert "identical" in out and "null keys in SEG_SQL: 1" in out
    report = str(tmp_path / "out.csv")
    with pytest.raises(AssertionError, match="1 rows differ"):
        tc.assert_files_approx_equal(spark, a, c, output_csv_path=report, **options)
    written = [p for p in tmp_path.iterdir() if p.name.startswith("out_")]
    assert len(written) == 1 and re.fullmatch(r"out_\d{4}(-\d\d){2}_\d\d(-\d\d){2}", written[0].name)
    assert spark.read.csv(str(written[0]), header=True).first()["AMOUNT_SPARK"] == "1.5"
    ranged = dict(options, ref_date_column="dtCutOff", start_date="2024-02-01", end_date="2024-02-29")
    tc.assert_files_approx_equal(spark, a, c, **ranged)
    tc.assert_files_approx_equal(spark, a, b, sample_by_col="seg", sample_fraction=0.5, **options)
    with pytest.raises(ValueError, match="not a key column"):
        tc.assert_files_approx_equal(spark, a, b, sample_by_col="amount", **options)


def test_text_against_typed_columns(spark, tmp_path, capsys):
    left, right = str(tmp_path / "l.csv"), str(tmp_path / "r.parquet")
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    df.write.option("header", True).csv(left, sep=";")
    df.write.parquet(right)
    tc.assert_files_approx_equal(spark, left, right, header=True, index_columns=["k"])
    assert "identical" in capsys.readouterr().out


def test_nothing_is_written_for_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, 1)], "k int, v int")
    path = tmp_path / "none"
    assert not tc.reconcile(df, df, ["k"]).write_report(str(path))
    assert not path.exists()
    assert tc.write_rows(df, str(path)) and tc.write_rows(df, str(path))
    assert tc.preview(df.union(df), 1).count() == 1


def test_tables_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, p string")
    folders = tc.write_tables({"one": df, "two": df.limit(1)}, str(tmp_path), fmt="csv")
    assert spark.read.csv(folders["one"], header=True).count() == 3
    tc.write_partitioned(df, str(tmp_path / "parts"), ["p"])
    assert {p.name for p in (tmp_path / "parts").iterdir() if p.is_dir()} == {
        "p=a", "p=b", "p=__HIVE_DEFAULT_PARTITION__",
    }
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 3


def test_a_large_partition_value_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(200_000).selectExpr("id", "IF(id % 100 < 90, 'hot', string(id % 100)) AS p")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        tc.write_partitioned(df.repartition(8), str(tmp_path / "b"), ["p"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    tc.write_partitioned(df.repartition(8), str(tmp_path / "r"), ["p"], rebalance=False)

    def files(name):
        return len(list((tmp_path / name).glob("*/*.parquet")))

    assert len(list((tmp_path / "b" / "p=hot").glob("*.parquet"))) > 2
    assert files("b") < files("r") == 8 * 11
    assert spark.read.parquet(str(tmp_path / "b")).count() == 200_000


def test_dictionaries(spark, tmp_path):
    terms = spark.createDataFrame([("A_B", "0123456789"), ('q"x\ny', "abcdef0123")], "term string, token string")
    path = str(tmp_path / "d")
    tc.write_dictionary(terms, path)
    assert sorted(tc.read_dictionary(spark, path).collect()) == sorted(terms.collect())
    (tmp_path / "o.json").write_text(json.dumps({r["term"]: r["token"] for r in terms.collect()}))
    both = tc.read_dictionary(spark, str(tmp_path / "o.json"), as_object=True)
    assert sorted(both.collect()) == sorted(terms.collect())
    for as_object in (True, False):
        missing = tc.read_dictionary(spark, str(tmp_path / "missing"), as_object=as_object)
        assert missing.columns == ["term", "token"] and missing.count() == 0


def test_texts(spark, tmp_path):
    (tmp_path / "a.sql").write_text('SELECT "x"\nFROM t')
    (tmp_path / "b.sql").write_text("SELECT 1")
    got = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in tc.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.sql": 'SELECT "x"\nFROM t', "b.sql": "SELECT 1"}
    df = spark.createDataFrame([(1, "a")], "i int, t string")
    tc.write_texts(df, str(tmp_path / "p"))
    tc.write_texts(df.select("t"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "a"


def test_text_numbers_in_files(spark, tmp_path):
    rows = [("a", "12d", "12f"), ("b", "9007199254740993", "9007199254740992"), ("c", "0012", "12"),
            ("d", "1e3", "1000"), ("e", "1.0", "1.00001"), ("f", "1.5E3", "1500"), ("g", "x", "x"),
            ("h", "123456789012345678901234567890", "123456789012345678901234567891")]
    paths = [str(tmp_path / f"{n}.csv") for n in "lr"]
    for i, path in enumerate(paths):
        df = spark.createDataFrame([(r[0], r[i + 1]) for r in rows], "k string, v string")
        tc.write_rows(df, path)
    options = {"sep": ",", "header": True}
    for left in (paths[0], paths[0] + "/"):
        found = tc.reconcile_files(spark, left, paths[1], ["k"], **options).rows
        assert sorted(r["K"] for r in found.collect()) == ["a", "b", "c", "d", "h"]
    named = tc.reconcile_files(spark, *paths, ["k"], numeric_cols=["v"], **options).rows
    assert sorted(r["K"] for r in named.collect()) == ["a", "b", "h"]
    with pytest.raises(ValueError, match="numeric_cols"):
        tc.reconcile_files(spark, *paths, ["k"], numeric_cols=["w"], **options)
    other = str(tmp_path / "plain")
    spark.read.csv(paths[0], **options).write.csv(other, **options)
    assert tc.reconcile_files(spark, other, paths[0], ["k"], fmt="csv", **options).rows.count() == 0


def test_reports_read_back_in_order(spark, tmp_path, capsys):
    df = spark.createDataFrame([(f"{i:03}", 'two\n"lines"') for i in range(50)], "k string, v string")
    path = str(tmp_path / "report")
    tc.write_rows(df.repartition(5), path, single_file=True, ordered_by=[df["k"].desc()])
    back = tc.read_report(spark, path).collect()
    assert [tuple(r) for r in back] == sorted(map(tuple, df.collect()), reverse=True)
    tc.assert_dataframes_approx_equal(
        df, df, index_columns=["k"], keep_equal=True, output_path_name=str(tmp_path / "same")
    )
    assert "the tables agree" in capsys.readouterr().out


def test_scratch_is_deleted_at_the_end(spark):
    from pathlib import Path

    def folders():
        root = Path(scratch_path(spark).removeprefix("file:")).parent
        return set(root.iterdir()) if root.exists() else set()

    before = folders()
    df = spark.range(100).selectExpr("id % 10 AS k", "id AS v")
    with tc.scratch(spark):
        with pytest.raises(AssertionError):
            tc.reconcile(df, df.selectExpr("k", "v + 1 AS v"), ["k"], hot_rows=2).assert_equal()
        assert folders() > before
    assert folders() == before


def test_scratch_follows_the_setting(spark):
    assert spark.conf.get("spark.checkpoint.dir") in scratch_path(spark)
    df = pin(spark.createDataFrame([(math.inf, None)], "`a b` double, `c.d` string"))
    assert df.columns == ["a b", "c.d"] and df.count() == 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert tc.configure(spark).conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    tc.configure(spark, {"spark.sql.debug.maxToStringFields": "300"}, input_bytes=2**40)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8192"
    tc.configure(spark, {"spark.sql.shuffle.partitions": before})
