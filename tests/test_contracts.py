from __future__ import annotations

import datetime as dt
import io
import json
import subprocess
import sys
import zipfile

import pyarrow as pa
import pytest
from pyspark import cloudpickle

import tablecheck as tc
from tablecheck.sources import archives, contracts, read_archives, table_name
from tablecheck.sources.contracts import ColumnRule
from workloads.snapshots import pack_reader

CONTRACT = {
    "loans": {"type_map": {
        "id": {"type": "int64", "nullable": False},
        "name": {"type": "string", "nullable": True},
        "rate": {"type": "float64", "nullable": True},
        "open": {"type": "boolean", "nullable": True},
        "start": {"type": "datetime64", "nullable": False},
    }},
    "codes": {"type_map": {"code": {"type": "object", "nullable": False}}},
}
# Columns in another order than declared, one undeclared, quotes and a line end in a cell.
LOANS = (
    "name;id;start;rate;open;note\n"
    '"a;b";1;2024-01-31;1.5;True;n1\n'
    '"say ""x""";2;2024-02-29;;false;\n'
    "NA;3;2024-03-01;2;;n3\n"
)
CODES = "code\nx\ny\n"


@pytest.fixture
def contract(spark, tmp_path):
    path = tmp_path / "contract.json"
    path.write_text(json.dumps(CONTRACT, indent=2))
    return tc.read_contract(spark, str(path))


def folder(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return [str(tmp_path / f"{name}.csv") for name in files]


def test_contract(spark, contract, tmp_path):
    assert set(contract) == {"loans", "codes"}
    assert {r.name: r.nullable for r in contract["loans"]}["id"] is False
    schema = tc.contract_schema(contract["loans"])
    assert schema["start"].dataType.simpleString() == "date" and not schema["id"].nullable
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as archive:
        archive.writestr("old.json", "{}")
        archive.writestr("new.json", json.dumps(CONTRACT))
    assert tc.read_contract(spark, str(tmp_path / "c.zip")) == contract
    (tmp_path / "empty.json").write_text("{}")
    with pytest.raises(ValueError, match="no tables"):
        tc.read_contract(spark, str(tmp_path / "empty.json"))


def test_ingest(spark, contract, tmp_path, rows):
    raw = tc.read_raw_tables(spark, folder(tmp_path, loans=LOANS, codes=CODES))
    assert tc.violations(raw, contract).count() == 0
    tc.ingest(raw, contract, str(tmp_path / "out"))
    loans = spark.read.parquet(str(tmp_path / "out" / "loans"))
    assert rows(loans) == sorted([
        ("a;b", 1, "2024-01-31", 1.5, True, "n1"),
        ('say "x"', 2, "2024-02-29", None, False, None),
        (None, 3, "2024-03-01", 2.0, None, "n3"),
    ], key=repr)
    assert rows(spark.read.parquet(str(tmp_path / "out" / "codes"))) == [("x",), ("y",)]
    dates = tc.conform(raw["loans"], "loans", contract["loans"], dates_as_text=False)
    assert dates.first()["start"] == dt.date(2024, 1, 31)


def test_violations_list_every_column(spark, contract, tmp_path, rows):
    broken = LOANS + "x;;2024-13-01;abc;yes;n\ny;1.5;;3;true;n\n"
    raw = tc.read_raw_tables(spark, folder(tmp_path, loans=broken, codes=CODES + "NULL\n"))
    assert rows(tc.violations(raw, contract)) == [
        ("codes", "code", "not_null", 1),
        ("loans", "id", "not_null", 1), ("loans", "id", "type", 1),
        ("loans", "open", "type", 1), ("loans", "rate", "type", 1),
        ("loans", "start", "not_null", 1), ("loans", "start", "type", 1),
    ]
    with pytest.raises(ValueError, match="codes.code: 1 not_null"):
        tc.ingest(raw, contract, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_contract_errors(spark, contract, tmp_path):
    raw = tc.read_raw_tables(spark, folder(tmp_path, codes="other\nx\n"))
    with pytest.raises(ValueError, match="columns missing from the file"):
        tc.violations(raw, contract).count()
    with pytest.raises(ValueError, match="without a contract"):
        tc.ingest({"else": raw["codes"]}, contract, str(tmp_path / "out"))
    rule = contract["codes"][0]
    with pytest.raises(ValueError, match="unknown contract type 'money'"):
        tc.contract_schema((type(rule)("c", "money", True),))


def test_files_of_a_table_must_share_the_header(spark, contract, tmp_path):
    (tmp_path / "codes").mkdir()
    (tmp_path / "codes" / "1.csv").write_text("code;note\nx;1\n")
    (tmp_path / "codes" / "2.csv").write_text("note;code\n1;x\n")
    raw = tc.read_raw_tables(spark, {"codes": str(tmp_path / "codes")})
    with pytest.raises(Exception, match="CSV header does not conform"):
        raw["codes"].collect()


def test_a_contract_may_demand_nothing(spark):
    raw = {"t": spark.createDataFrame([(None, "1")], "a string, b string")}
    rules = {"t": (ColumnRule("a", "string", True), ColumnRule("b", "object", True))}
    assert tc.violations(raw, rules).count() == 0


def test_uneven_records_are_counted(spark, tmp_path, rows):
    rules = {"t": (ColumnRule("a", "string", True), ColumnRule("b", "string", True))}
    text = 'a;b\n1;2\n"two\nlines";3\n4\n5;6;7\n"x;y";8\n'
    raw = tc.read_raw_tables(spark, folder(tmp_path, t=text))
    assert rows(tc.violations(raw, rules)) == [("t", "(record)", "cells", 3)]
    whole = tc.read_raw_tables(spark, folder(tmp_path, t=text), multi_line=True)
    assert rows(tc.violations(whole, rules)) == [("t", "(record)", "cells", 2)]
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as archive:
        archive.writestr("t.csv", text)
    packed = read_archives(spark, str(tmp_path / "t.zip"))
    assert rows(tc.violations(packed, rules)) == [("t", "(record)", "cells", 2)]
    assert tc.conform(packed["t"], "t", rules["t"]).columns == ["a", "b"]
    with pytest.raises(ValueError, match=r"t.\(record\): 2 cells"):
        tc.ingest(packed, rules, str(tmp_path / "out"))


def test_multi_line_cells(spark, contract, tmp_path):
    text = 'code\n"two\nlines"\nz\n'
    raw = tc.read_raw_tables(spark, folder(tmp_path, codes=text), multi_line=True)
    assert {r["code"] for r in raw["codes"].collect()} == {"two\nlines", "z"}


def test_archives(spark, contract, tmp_path, rows):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as archive:
        archive.writestr("in/loans.2024.csv", LOANS)
        archive.writestr("readme.txt", "x")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as archive:
        archive.writestr("loans.csv", LOANS.split("\n")[0] + '\n"two\nlines";9;2024-01-01;;;\n')
        archive.writestr("codes.csv", "﻿" + CODES)
        archive.writestr("empty.csv", "")
        archive.writestr("bare.csv", "only;header\n")
    tables = read_archives(spark, str(tmp_path / "*.zip"))
    assert set(tables) == {"loans", "codes", "bare"}
    assert tables["bare"].columns == ["only", "header", "_uneven_record"] and tables["bare"].count() == 0
    typed = tc.conform(tables["loans"], "loans", contract["loans"])
    assert rows(typed, "id", "name") == sorted(
        [(1, "a;b"), (2, 'say "x"'), (3, None), (9, "two\nlines")], key=repr
    )
    assert rows(tables["codes"], "code") == [("x",), ("y",)]
    with zipfile.ZipFile(tmp_path / "three.zip", "w") as archive:
        archive.writestr("codes.csv", "kode\nx\n")
    with pytest.raises(ValueError, match="different headers"):
        read_archives(spark, str(tmp_path / "*.zip"))


def test_task_code_needs_no_package():
    readers = [
        archives._record_reader(";", 2), contracts._last_member_reader(),
        pack_reader("t"),
    ]
    code = "import pickle, sys; [f([]) for f in pickle.load(sys.stdin.buffer)]"
    done = subprocess.run(
        [sys.executable, "-c", code], input=cloudpickle.dumps(readers), cwd="/", env={},
        capture_output=True,
    )
    assert done.returncode == 0, done.stderr


def test_large_members_come_in_batches():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("t.csv", "a\n" + "".join(f"{i}\n" for i in range(5)))
    frames = list(archives._record_reader(";", 2)([pa.RecordBatch.from_pydict({"content": [buffer.getvalue()]})]))
    assert [len(f) for f in frames] == [1, 2, 2, 1]


def test_long_cells_in_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "long.zip", "w") as archive:
        archive.writestr("t.csv", "a;b\n1;" + "x" * 200_000 + "\n")
    tables = read_archives(spark, str(tmp_path / "long.zip"))
    assert len(tables["t"].first()["b"]) == 200_000


def test_table_names():
    assert table_name("a/b/loans.2024.csv") == "loans"
