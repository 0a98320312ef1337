from __future__ import annotations

import datetime as dt

import pytest

from garimpo import fixed_values as fv
from garimpo.parameters import Parameters
from garimpo.plans import pipeline
from garimpo.sinks.stages import read_stage
from garimpo.sources import federal_debt, header_csv, periods, registry, sanctions, state_debt
from tests.sample import FEDERAL_DEBT, FEDERAL_HEADER, write

THREE = ("a", "b", "c")


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_positional_csv_ugly_lines(spark, tmp_path):
    path = tmp_path / "x.csv"
    write(
        path,
        '1;AÇÃO;x\n2;B\n3;"C;""q""";z\n4;D;y;extra\n5;E;y;\n\n6;"";\n7;G "m";w\n8;H;  k \n',
    )
    read = registry.read_positional_csv(spark, THREE, str(path))
    assert rows_of(read) == [
        ("1", "AÇÃO", "x"),
        ("2", "B", None),
        ("3", 'C;"q"', "z"),
        ("6", None, None),
        ("7", 'G "m"', "w"),
        ("8", "H", "  k "),
    ]
    # The same lines are kept whatever columns are asked for.
    assert read.select("a").count() == 6
    rejected = registry.rejected_lines(spark, THREE, str(path))
    assert sorted((r.largura, r.linha) for r in rejected.collect()) == [
        (4, "4;D;y;extra"),
        (4, "5;E;y;"),
    ]


def test_line_width(spark):
    cases = {
        "1;2;3": 3,
        '"a;b";c': 2,
        '"a";"b;c";"d"': 3,
        'x "y;z" w': 2,
        '"q""q;";1': 2,
        ";;": 3,
        "one": 1,
        '"' + "x;" * 20000 + '";2': 2,
    }
    frame = spark.createDataFrame([(k, v) for k, v in cases.items()], "line string, width int")
    got = frame.select("width", registry.line_width(frame.line).alias("got")).collect()
    assert all(r.width == r.got for r in got)


def test_layout_guard(spark, tmp_path):
    good, bad, late, empty = (str(tmp_path / n) for n in ("good", "bad", "late", "empty"))
    write(tmp_path / "good", "1;2;3;4;5;6;7\n")
    write(tmp_path / "bad", "1;2;3\n4;5;6\n")
    write(tmp_path / "late", "1;2;3\n" * 50 + "1;2;3;4;5;6;7\n")
    write(tmp_path / "empty", "")
    registry.check_layout(spark, fv.EMPRESAS, [good, empty])
    with pytest.raises(registry.LayoutMismatch, match="7 columns declared"):
        registry.check_layout(spark, fv.EMPRESAS, [good, bad])
    with pytest.raises(registry.LayoutMismatch):
        registry.check_layout(spark, fv.EMPRESAS, [late])
    profile = registry.layout_profile(spark, [late, good])
    found = sorted((r.arquivo.split("/")[-1], r.largura, r.linhas) for r in profile.collect())
    assert found == [("good", 7, 1), ("late", 3, 50), ("late", 7, 1)]


def test_slices_and_suffixes(spark, tmp_path):
    for number, name in ((0, "A.EMPRECSV"), (3, "b.emprecsv"), (7, "C.EmpreCsv")):
        write(tmp_path / f"Empresas{number}" / name, f"{number};X;2062;49;1,00;05;\n")
    write(tmp_path / "Empresas0" / "note.txt", "not;a;company\n")
    write(tmp_path / "Empresas0" / "B.ESTABELE", "not;a;company\n")

    def keys(slices):
        read = registry.read_table(spark, str(tmp_path), "empresas", slices=slices)
        return sorted(r.cnpj_basico for r in read.collect())

    write(tmp_path / "Empresas11" / "D.EMPRECSV", "11;X;2062;49;1,00;05;\n")
    assert keys(None) == ["0", "11", "3", "7"]
    assert keys(10) == ["0", "3", "7"]
    assert keys(4) == ["0", "3"]
    assert keys(1) == ["0"]
    with pytest.raises(registry.SourceMissing):
        registry.read_table(spark, str(tmp_path), "socios")


def test_uf_filter_reaches_the_scan(spark, tmp_path):
    line = ";".join("MG" if c == "uf" else "x" for c in fv.ESTABELECIMENTOS)
    other = line.replace("MG", "SP")
    write(tmp_path / "e", f"{line}\n{other}\n")
    read = registry.read_positional_csv(spark, fv.ESTABELECIMENTOS, str(tmp_path / "e"), uf="MG")
    assert read.count() == 1
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(uf,MG)" in plan


def test_latest_period_folder(spark, tmp_path):
    for month in ("2025-12", "2026-06", "2026-05"):
        write(tmp_path / "plain" / month / "Cnaes" / "x.CNAECSV", "1;a\n")
        write(tmp_path / "keyed" / f"competencia={month}" / "x.CNAECSV", "1;a\n")
    write(tmp_path / "flat" / "Cnaes" / "x.CNAECSV", "1;a\n")

    def newest(name):
        return periods.latest_period_folder(spark, str(tmp_path / name))[len(str(tmp_path)) :]

    assert newest("plain") == "/plain/2026-06"
    assert newest("keyed") == "/keyed/competencia=2026-06"
    assert newest("flat") == "/flat"


def test_latest_period_prunes_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("2026-05", 1), ("2026-06", 2)], "competencia string, n int")
    rows.write.partitionBy("competencia").parquet(str(tmp_path / "t"))
    newest = periods.latest_period(spark.read.parquet(str(tmp_path / "t")))
    assert [r.n for r in newest.collect()] == [2]
    assert "PartitionFilters: [isnotnull(competencia" in (
        newest._jdf.queryExecution().executedPlan().toString()
    )


def test_latest_snapshot_files(spark, tmp_path):
    for name in ("ceis_20260729", "ceis_20260725", "cnep_20260720", "cepim_20260719"):
        write(tmp_path / name / "data.csv", "x\n")
    found = periods.latest_snapshot_files(spark, str(tmp_path), dt.date(2026, 7, 29))
    names = {register: [p.split("/")[-2] for p in paths] for register, paths in found.items()}
    # Nine days back still counts, ten days back does not.
    assert names == {"CEIS": ["ceis_20260729"], "CNEP": ["cnep_20260720"]}


def test_latest_snapshot(spark):
    day = dt.date(2026, 7, 29)
    rows = spark.createDataFrame(
        [
            ("CEIS", day, 1),
            ("CEIS", day - dt.timedelta(1), 2),
            ("CNEP", day - dt.timedelta(9), 3),
            ("CEPIM", day - dt.timedelta(10), 4),
            ("CEIS", day + dt.timedelta(1), 5),
        ],
        "cadastro string, snapshot_date date, n int",
    )
    assert [r.n for r in periods.latest_snapshot(rows, day).orderBy("n").collect()] == [1, 3]


def test_names():
    assert header_csv.normalise_name("Valor  Consolidado (R$)") == "valor_consolidado_r"
    assert header_csv.normalise_name("ÓRGÃO SANCIONADOR") == "orgao_sancionador"
    real = header_csv.resolve_names(
        ["CNPJ/CPF", "Ni Devedor", "UF", "uf", "Valor"], fv.FEDERAL_DEBT_ALIASES
    )
    assert real["cpf_cnpj"] == "CNPJ/CPF"
    assert real["uf_devedor"] == "uf"
    assert real["valor_consolidado"] == "Valor"
    assert real["data_inscricao"] is None


def test_federal_debt_files(spark, tmp_path):
    write(tmp_path / "a.csv", FEDERAL_DEBT)
    write(
        tmp_path / "b.csv",
        "NI DEVEDOR;Número da Inscrição;Valor\n10.000.004/0001-31;9;1,50\n***123**;8;2,00\n",
    )
    write(tmp_path / "c.csv", "Nome;Valor\nsem id;1,00\n")
    files = [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv")]
    read = federal_debt.read(spark, {"Geral": files, "FGTS": []}, uf="MG")
    got = {r.numero_inscricao: r for r in read.collect()}
    # The file without a state column keeps its rows, the one without ids is skipped.
    assert sorted(got) == ["80.1.24.000123-45", "80.1.24.000124-46", "80.6.23.000987-11", "9"]
    assert got["9"].cpf_cnpj == "10000004000131" and got["9"].cnpj_basico == "10000004"
    assert got["9"].tipo_pessoa is None and float(got["9"].valor_consolidado) == 1.5
    assert federal_debt.read(spark, {"FGTS": []}, uf=None).count() == 0


def test_federal_debt_state_filter(spark, tmp_path):
    states = ["MG", " mg ", "", "SP"]
    body = "".join(f"1000000100015{n};{state};{n}\n" for n, state in enumerate(states))
    write(tmp_path / "a.csv", "CPF_CNPJ;UF;NUMERO_INSCRICAO\n" + body)
    read = federal_debt.read(spark, {"Geral": [str(tmp_path / "a.csv")]}, uf="MG")
    assert sorted(r.numero_inscricao for r in read.collect()) == ["0", "1", "2"]


def test_header_csv_odd_lines(spark, tmp_path):
    write(tmp_path / "a.csv", "CNPJ;Nome;NOME;a.b;\n1;x;y;z;w\n2;x\n3;x;y;z;w;v\n")
    read = header_csv.read_header_csv(spark, str(tmp_path / "a.csv"))
    assert read.columns == ["CNPJ", "Nome", "NOME_2", "a.b", "column4"]
    assert rows_of(read) == [("1", "x", "y", "z", "w"), ("2", "x", None, None, None)]
    write(tmp_path / "empty.csv", "")
    assert header_csv.read_canonical(
        spark, [str(tmp_path / "empty.csv")], fv.SANCTION_ALIASES
    ) is None


def test_rejects_of_header_files(spark, tmp_path):
    """A bare delimiter is rejected and counted, a quoted break is not; drift stops the load."""
    write(tmp_path / "g" / "a.csv", "CPF_CNPJ;Nome;Valor\n" + "10000001000155;A;1,00\n" * 9 +
          '10000001000155;B;C;2,00\n10000001000155;"D\nE";3,00\n10000001000155;F\n')
    write(tmp_path / "g" / "b.csv", "Nome;Valor\nsem;id;1,00\n")
    stage = str(tmp_path / "stage")
    folders = {"Geral": str(tmp_path / "g"), "FGTS": str(tmp_path / "nothing")}
    loaded = pipeline.ingest_federal_debt(spark, folders, stage, Parameters(uf=None))
    assert loaded["divida_ativa_uniao"] == 11 and loaded["divida_ativa_uniao_recusadas"] == 1
    assert [n for name, n in loaded.items() if name.endswith("a.csv")] == [1]
    rejected = read_stage(spark, f"{stage}/divida_ativa_uniao_recusadas")
    assert [(r.largura, r.linha) for r in rejected.collect()] == [(4, "10000001000155;B;C;2,00")]
    names = read_stage(spark, f"{stage}/divida_ativa_uniao").select("nome_devedor").distinct()
    assert {r.nome_devedor for r in names.collect()} == {"A", "D\nE", "F"}
    write(tmp_path / "s" / "ceis_20260729" / "x.csv", "CNPJ;UF\n" + "1;MG\n" * 55 + "1;M;G\n" * 60)
    with pytest.raises(registry.LayoutMismatch):
        pipeline.ingest_sanctions(spark, str(tmp_path / "s"), stage, dt.date(2026, 7, 29))


def test_one_scan_per_header(spark, tmp_path):
    for name in ("a", "b", "c"):
        write(tmp_path / name, FEDERAL_DEBT)
    write(tmp_path / "d", FEDERAL_HEADER.lower())
    read = header_csv.read_canonical(
        spark, [str(tmp_path / n) for n in "abcd"], fv.FEDERAL_DEBT_ALIASES
    )
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2
    assert read.count() == 12


def test_sanctions_keep_expired(spark, tmp_path):
    write(
        tmp_path / "a.csv",
        "CNPJ;CATEGORIA DA SANÇÃO;DATA DE FIM DA SANÇÃO\n"
        "10.000.007/0001-20;Multa;01/01/2001\n123.456.789-00;Multa;\n",
    )
    (row,) = sanctions.read(spark, {"CNEP": [str(tmp_path / "a.csv")]}).collect()
    assert (row.cadastro, row.tipo_sancao, row.data_fim) == ("CNEP", "Multa", "01/01/2001")


def test_state_debt_window(spark, tmp_path):
    as_of = dt.date(2025, 12, 31)
    # 365 days before is 2024-12-31, serial 45657.
    write(
        tmp_path / "m.csv",
        "h1;h2;h3;h4;h5;h6;h7\n"
        "10.000.001/0001-55;A;1;45657.0;ICMS;10.5;x\n"
        "10.000.001/0001-55;A;2;45656.99;ICMS;1;1\n"
        "10.000.001/0001-55;A;3;45658.75;ICMS;;2.25\n"
        "10.000.001/0001-55;A;4;sem data;ICMS;1;1\n"
        "10.000.001/0001-55;A;5;99999999;ICMS;1;1\n"
        "001.234567.00-89;A;6;45658;ICMS;1;1\n"
        "10000001000155.0;A;7;45658;ICMS;1;1\n"
        "10.000.001/0001-55;A;8;45658;ICMS;1\n"
        "10.000.001/0001-55;A;9;45658;ICMS;1;1;eighth\n",
    )
    cells = state_debt.read_cells(spark, str(tmp_path / "m.csv"))
    got = {r.numero_cda: r for r in state_debt.clean(cells, as_of, 365).collect()}
    assert sorted(got) == ["1", "3", "5", "9"]
    assert got["1"].data_inscricao == "2024-12-31"
    assert got["1"].saldo_nucleo is None and float(got["1"].saldo_cda) == 10.5
    assert got["3"].data_inscricao == "2025-01-01" and got["3"].saldo_cda is None
    assert got["5"].data_inscricao is None
