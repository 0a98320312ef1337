"""Records with line breaks inside quotes, against the csv module over the whole file."""

from __future__ import annotations

import csv
import io
import random

import pytest

from garimpo import fixed_values as fv
from garimpo.sources import header_csv, records, registry
from tests.sample import write

THREE = ("a", "b", "c")


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize(
    "text, rows, rejected",
    [
        ('1;"A\nB;C";x\n', [("1", "A\nB;C", "x")], []),
        ('1;"A\nm;n;o\nB";x\n', [("1", "A\nm;n;o\nB", "x")], []),
        ('1;b;"line one\nline two"\n2;c;d\n', [("1", "b", "line one\nline two"), ("2", "c", "d")],
         []),
        ('1;"A\n\n\nB";x\n\n2;c;d\n', [("1", "A\n\n\nB", "x"), ("2", "c", "d")], []),
        ('1;"A ""q\n"";B";x\n', [("1", 'A "q\n";B', "x")], []),
        ('1;5" tube;x\n2;y" z;w\n', [("1", '5" tube', "x"), ("2", 'y" z', "w")], []),
        ('1;"A\nB";x;y\n2;c;d\n', [("2", "c", "d")], ['1;"A\nB";x;y']),
        ('1;b;c\n2;"never closed;d\n3;e;f\n', [("1", "b", "c")], ['2;"never closed;d', "3;e;f"]),
    ],
)
def test_whole_records(spark, tmp_path, text, rows, rejected):
    write(tmp_path / "x.csv", text)
    path = str(tmp_path / "x.csv")
    assert rows_of(registry.read_positional_csv(spark, THREE, path)) == rows
    found = registry.rejected_lines(spark, THREE, path)
    assert sorted(r.linha for r in found.collect()) == sorted(rejected)


def test_records_across_splits(spark, tmp_path):
    """Small splits: records start in one and end in another, or cover whole ones."""
    pick = random.Random(5)
    wanted = []
    for i in range(400):
        text = "".join(pick.choice(['a', ';', '"', '\n', 'é', '1;2;3\n']) for _ in range(
            pick.choice([0, 3, 3, 60])))
        wanted.append((str(i), text.strip() or None, pick.choice(["x", "\n", 'y"'])))
    out = io.StringIO()
    csv.writer(out, delimiter=";", lineterminator="\n").writerows(wanted)
    write(tmp_path / "x.csv", out.getvalue())
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        lines = records.raw_lines(spark, str(tmp_path / "x.csv"))
        assert lines.select("bloco").distinct().count() > 20
        read = registry.read_positional_csv(spark, THREE, str(tmp_path / "x.csv"))
        got = {r.a: (r.b, r.c) for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert got == {a: (b, c) for a, b, c in wanted}


def test_only_broken_files_are_stitched(spark, tmp_path):
    write(tmp_path / "plain.csv", "1;b;c\n" * 20)
    write(tmp_path / "broken.csv", '2;"b\nb";c\n3;b;c\n')
    read = registry.read_positional_csv(spark, THREE, str(tmp_path), glob="*.csv")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "broken.csv" in plan
    assert read.count() == 22
    write(tmp_path / "broken.csv", "2;b;c\n")
    read = registry.read_positional_csv(spark, THREE, str(tmp_path), glob="*.csv")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "Exchange" not in plan


def test_header_files(spark, tmp_path):
    write(tmp_path / "a.csv", 'CPF_CNPJ;"NOME";VALOR\n1;"A\nB";1,00\n2;C;2,00\n3;D;E;4\n')
    write(tmp_path / "b.csv", 'CPF_CNPJ;NOME;VALOR\n4;D;1,00\n')
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv")]
    read = header_csv.read_header_csv(spark, paths)
    assert read.columns == ["CPF_CNPJ", "NOME", "VALOR"]
    assert rows_of(read) == [("1", "A\nB", "1,00"), ("2", "C", "2,00"), ("4", "D", "1,00")]
    rejected = header_csv.rejected_canonical(spark, paths, fv.FEDERAL_DEBT_ALIASES, check=False)
    assert [r.linha for r in rejected.collect()] == ["3;D;E;4"]


def test_headers_need_no_job(spark, tmp_path):
    for i in range(60):
        write(tmp_path / f"{i}.csv", f"\nCNPJ;Nome;x{i % 2}\n1;2;3\n")
    files = [str(tmp_path / f"{i}.csv") for i in range(60)]
    group = spark.sparkContext.setJobGroup("headers", "headers")
    found = header_csv.by_header(spark, files)
    assert {names: len(paths) for names, paths in found.items()} == {
        ("CNPJ", "Nome", "x0"): 30, ("CNPJ", "Nome", "x1"): 30,
    }
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    spark.sparkContext._jsc.clearJobGroup()
    assert group is None


def test_long_open_quotes_are_rejected_line_by_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MAX_RECORD", 50)
    write(tmp_path / "x.csv", '1;"a;b\n' + "2;b;c\n" * 20 + '3;"x";c\n4;d;e\n')
    read = registry.read_positional_csv(spark, THREE, str(tmp_path / "x.csv"))
    assert rows_of(read) == [("4", "d", "e")]
    assert registry.rejected_lines(spark, THREE, str(tmp_path / "x.csv")).count() == 22
