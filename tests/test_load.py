"""Loading files into stage tables: one scan, safe swaps, an account of every line."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest

from garimpo import fixed_values as fv
from garimpo.parameters import Parameters
from garimpo.plans import job, pipeline
from garimpo.plans.load import Source, load
from garimpo.sinks import versions
from garimpo.sinks.stages import read_stage
from garimpo.sources.records import SourceMissing
from garimpo.sources.registry import LayoutMismatch
from tests.sample import AS_OF, write, write_landing

ANY = Parameters(uf=None)
DEBTS = "CPF_CNPJ;NOME;VALOR\n"


def _quarter(folder, *lines):
    write(folder / "geral" / "a.csv", DEBTS + "".join(f"{line}\n" for line in lines))
    return {"Geral": str(folder / "geral"), "FGTS": str(folder / "fgts")}


def _names(spark, stage):
    rows = read_stage(spark, f"{stage}/divida_ativa_uniao").collect()
    return sorted(row.nome_devedor for row in rows)


def test_missing_quarter_leaves_the_old_table(spark, tmp_path):
    stage = str(tmp_path / "stage")
    first = _quarter(tmp_path / "q1", "10000001000155;A;1,00")
    assert pipeline.ingest_federal_debt(spark, first, stage, ANY)["divida_ativa_uniao"] == 1
    with pytest.raises(SourceMissing):
        pipeline.ingest_federal_debt(spark, {"Geral": str(tmp_path / "none")}, stage, ANY)
    write(tmp_path / "q2" / "x.csv", "NOME;VALOR\nA;1,00\n")
    with pytest.raises(SourceMissing):
        pipeline.ingest_federal_debt(spark, {"Geral": str(tmp_path / "q2")}, stage, ANY)
    assert _names(spark, stage) == ["A"]
    with pytest.raises(SourceMissing):
        pipeline.ingest_sanctions(spark, str(tmp_path / "none"), stage, dt.date(2026, 1, 1))
    with pytest.raises(SourceMissing):
        pipeline.ingest_state_debt(spark, str(tmp_path / "none"), stage, ANY, AS_OF)


def test_failed_runs_leave_the_old_tables(spark, tmp_path, monkeypatch):
    stage = str(tmp_path / "stage")
    pipeline.ingest_federal_debt(
        spark, _quarter(tmp_path / "q1", "10000001000155;A;1,00"), stage, ANY
    )
    drifted = _quarter(tmp_path / "q2", *["10000001000155;B;1,00;x"] * 3, "10000001000155;B;1,00")
    with pytest.raises(LayoutMismatch, match="3 of 4 lines"):
        pipeline.ingest_federal_debt(spark, drifted, stage, ANY)
    assert _names(spark, stage) == ["A"]

    def fails(*_):
        raise RuntimeError("lost")

    good = _quarter(tmp_path / "q3", "10000001000155;C;1,00")
    monkeypatch.setattr(pipeline, "_commit", fails)
    with pytest.raises(RuntimeError, match="lost"):
        pipeline.ingest_federal_debt(spark, good, stage, ANY)
    assert _names(spark, stage) == ["A"]
    monkeypatch.undo()

    held = read_stage(spark, f"{stage}/divida_ativa_uniao")
    pipeline.ingest_federal_debt(spark, good, stage, ANY)
    assert _names(spark, stage) == ["C"]
    # Who looked the table up before keeps reading it, until old versions are dropped.
    assert [row.nome_devedor for row in held.collect()] == ["A"]
    assert len(versions.drop_unused(spark, stage)) >= 2
    assert _names(spark, stage) == ["C"]


def test_registry_is_replaced_as_a_whole(spark, tmp_path, monkeypatch):
    write_landing(tmp_path)
    stage = str(tmp_path / "stage")
    params = Parameters()
    loaded = pipeline.ingest_registry(spark, str(tmp_path / "receita"), stage, params)
    assert loaded["empresas"] == 9
    before = versions.current(spark, stage)
    month = next(p for p in (tmp_path / "receita").iterdir() if p.is_dir())
    for path in (month / "Motivos").iterdir():
        path.unlink()
    with pytest.raises(SourceMissing, match="motivos"):
        pipeline.ingest_registry(spark, str(tmp_path / "receita"), stage, params)
    assert versions.current(spark, stage) == before
    # A list that nothing reads may be missing.
    write_landing(tmp_path)
    for path in (month / "Paises").iterdir():
        path.unlink()
    again = pipeline.ingest_registry(spark, str(tmp_path / "receita"), stage, params)
    assert again["paises"] == 0 and again["empresas"] == 9
    assert versions.current(spark, stage)["empresas"] != before["empresas"]


def test_every_line_is_accounted_for(spark, tmp_path):
    stage = str(tmp_path / "stage")
    folders = _quarter(
        tmp_path / "q", "10000001000155;A;1,00", "12345678901;natural person;1,00",
        "10000001000155;B;C;2,00", '10000001000155;"D', 'E";3,00',
    )
    write(tmp_path / "q" / "fgts" / "b.csv", DEBTS + "10000001000155;F;1,00\n")
    pipeline.ingest_federal_debt(spark, folders, stage, ANY)
    write(tmp_path / "mg" / "m.csv", "1;2;3;4;5;6;7\n10000001000155;A;1;46000;ICMS;1;1\n1;2;3\n")
    pipeline.ingest_state_debt(spark, str(tmp_path / "mg"), stage, ANY, AS_OF)
    account = pipeline.load_audit(spark, stage).collect()
    got = {
        (r.tabela, r.parte, r.arquivo.split("/")[-1]): (r.lidas, r.carregadas, r.recusadas)
        for r in account
    }
    assert got == {
        # The record of two lines is one row; the natural person is not asked for.
        ("divida_ativa_uniao", "Geral", "a.csv"): (5, 2, 1),
        ("divida_ativa_uniao", "FGTS", "b.csv"): (1, 1, 0),
        ("divida_ativa_mg", "todas", "m.csv"): (2, 1, 1),
    }
    rejected = read_stage(spark, f"{stage}/divida_ativa_mg_recusadas").collect()
    assert [(r.largura, r.linha) for r in rejected] == [(3, "1;2;3")]


def _jobs(spark, action):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_one_scan_writes_rows_and_rejects(spark, tmp_path):
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    counts = []
    for files in (12, 30):
        folder = tmp_path / str(files)
        for i in range(files):
            write(folder / f"{i}.csv", "1;b;c\n" * 5 + "1;b;c;d\n")
        paths = [str(folder / f"{i}.csv") for i in range(files)]
        source = Source("todas", paths, ("a", "b", "c"), lambda rows: rows)
        done = []
        stage = str(tmp_path / f"stage{files}")
        counts.append(_jobs(spark, lambda: done.append(load(spark, stage, "t", [source]))))
        assert (done[0].loaded, done[0].rejected) == (5 * files, files)
        versions.commit(spark, stage, done[0].versions)
        assert read_stage(spark, f"{stage}/t").count() == 5 * files
    # A write and a count of what was written. (Beyond 32 paths Spark lists files in jobs.)
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert counts[0] == counts[1] <= 3


def test_two_commits_do_not_lose_each_other(spark, tmp_path):
    stage = str(tmp_path)
    for number in range(3):
        versions.commit(spark, stage, {f"t{number}": versions.Version(f"t{number}/versao-a")})
    versions.commit(spark, stage, {"t0": versions.Version("t0/versao-b")}, gone=["t2"])
    assert {name: v.folder for name, v in versions.current(spark, stage).items()} == {
        "t0": "t0/versao-b", "t1": "t1/versao-a",
    }


def test_transform_writes_two_tables(spark, tmp_path):
    write_landing(tmp_path)
    stage = str(tmp_path / "stage")
    job.ingest(spark, str(tmp_path), stage, Parameters(), AS_OF)
    tables = pipeline.transform(spark, stage, Parameters())
    found = versions.current(spark, stage)
    names = ("universo_com_apontamentos", "universo", "apontamentos", "leads")
    assert len({found[name].folder for name in names}) == 2
    assert len(tables["universo"].columns) == 28
    assert set(fv.REGISTRY_LAYOUTS) <= set(found)
