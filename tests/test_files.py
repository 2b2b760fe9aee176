"""Files in many splits: rows, numbers and errors as if read whole; one file written from many parts."""

import csv
import io
import random

import pytest

from loomtab.cli import main
from loomtab.plans.model import DecodeFailure
from loomtab.sources import files


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cell():
    return random.choice(["", "a", 'q"uo"te', "two\nlines", 'x"', "東京", "comma,", "\n\n", "long " * 30, "cr\r\nlf", '"', "é;|"])


@pytest.mark.parametrize("encoding, delimiter", [("utf-8", ","), ("shift_jis", "|"), ("euc-jp", "\t")])
def test_rows_over_splits(spark, tmp_path, small_splits, encoding, delimiter):
    random.seed(5)
    rows = [[cell().replace("é", "ソ" if encoding != "utf-8" else "é") for _ in range(random.randrange(1, 5))] for _ in range(150)]
    rows = [r for r in rows if r != [""]]
    raw = "".join(files.format_row(r, delimiter, "\n") + random.choice(["", "", "\n"]) for r in rows) + f'5" disk{delimiter}x"y\n'
    path = tmp_path / "in.csv"
    path.write_bytes(raw.encode({"shift_jis": "cp932", "euc-jp": "euc_jp"}.get(encoding, encoding)))
    want = [r for r in csv.reader(io.StringIO(raw, newline=""), delimiter=delimiter) if r]
    assert files._lines(spark, str(path)).rdd.getNumPartitions() > 5
    for header in (False, True):
        got = files.read_rows(spark, str(path), encoding, delimiter, header).collect()
        assert [r.fields for r in got] == want[header:] and [r.row for r in got] == list(range(1, len(want) + 1 - header))
    assert files.probe(spark, str(path), encoding, delimiter, True).header == want[0]


def test_a_cell_over_many_splits(spark, tmp_path, small_splits):
    path = tmp_path / "in.csv"
    long = "\n".join(f"line {k}" for k in range(400))
    path.write_text(f'a,b\n1,"{long}"\n2,x\n')
    assert [r.fields for r in files.read_rows(spark, str(path), "utf-8", ",", True).collect()] == [["1", long], ["2", "x"]]
    path.write_text(f'a\n"{long}')
    assert [r.fields for r in files.read_rows(spark, str(path), "utf-8", ",", True).collect()] == [[long]]
    path.write_bytes(b"")
    assert files.read_rows(spark, str(path), "utf-8", ",", True).collect() == [] and files.probe(spark, str(path), "auto", ",", True).header == []


def test_command_over_splits(spark, tmp_path, small_splits, capsys):
    source, target = tmp_path / "in.csv", tmp_path / "out.csv"
    source.write_bytes("﻿n,m\r\n".encode() + "".join(f'{k},"x\r\n{k}"\r\n' for k in range(500)).encode())
    target.write_text("old")
    assert main(["flag", "-i", str(source), "-o", str(target), "-c", "n", "--pattern", "7$", "--out-col", "f"], spark) == 0
    assert target.read_bytes().decode() == "n,m,f\r\n" + "".join(f'{k},"x\r\n{k}",{"true" if k % 10 == 7 else "false"}\r\n' for k in range(500))
    assert "f: ヒット 50 行" in capsys.readouterr().out and sorted(x.name for x in tmp_path.iterdir()) == ["in.csv", "out.csv"]
    source.write_bytes(source.read_bytes() + b"\xff\xfe,x\r\n")
    target.unlink()
    assert main(["mask", "-i", str(source), "-o", str(target), "-c", "n"], spark) == 1 and [x.name for x in tmp_path.iterdir()] == ["in.csv"]


def test_ties_are_told(spark, tmp_path, capsys):
    (tmp_path / "d.csv").write_text("c\nkite\nbite\n")
    (tmp_path / "in.csv").write_text("n\nkite\nsite\n")
    assert main(["similarity", "-i", str(tmp_path / "in.csv"), "-o", str(tmp_path / "out.csv"), "-c", "n", "--dict", str(tmp_path / "d.csv")], spark) == 0
    assert (tmp_path / "out.csv").read_text() == "n,matched_name,score\nkite,kite,1.0000\nsite,kite,0.7500\n"
    assert capsys.readouterr().err.count("row 2 (matched_name) has a tie") == 1


def test_decode_failure(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes(b"a\n\x80\n")
    with pytest.raises(Exception, match=DecodeFailure.__name__):
        files.read_rows(spark, str(tmp_path / "in.csv"), "utf-8", ",", False).collect()
