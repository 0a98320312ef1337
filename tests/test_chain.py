"""The whole chain on the sample companies, from files to sheet."""

from __future__ import annotations

import pathlib

import pytest

from garimpo import fixed_values as fv
from garimpo.operators import reports, search
from garimpo.operators.ordering import PLACE, parts_of_order, slice_of_stored_order, sort_columns
from garimpo.parameters import Parameters
from garimpo.plans import job, pipeline
from garimpo.sinks.audit import DuplicateKeys
from garimpo.sinks.stages import append_stage, ordered_writer, read_stage, replace_stage
from tests.sample import AS_OF, write_landing

PARAMS = Parameters()


@pytest.fixture(scope="module")
def stage(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("landing")
    write_landing(root)
    target = str(tmp_path_factory.mktemp("stage"))
    loaded = job.ingest(spark, str(root), target, PARAMS, AS_OF)
    pipeline.transform(spark, target, PARAMS)
    return target, loaded


@pytest.fixture(scope="module")
def all_leads(spark, stage):
    rows = pipeline.build_leads(
        pipeline.load_tables(spark, stage[0]), PARAMS.replace(somente_com_apontamento=False)
    )
    return {row.cnpj_basico: row for row in rows.collect()}


def test_rows_loaded(stage):
    loaded = dict(stage[1])
    rejected = [loaded.pop(name) for name in list(loaded) if name.endswith("_recusadas")]
    assert rejected == [0] * 10
    assert loaded == {
        "empresas": 9,
        "estabelecimentos": 9,
        "socios": 3,
        "simples": 4,
        "cnaes": 5,
        "motivos": 2,
        "municipios": 4,
        "naturezas": 2,
        "paises": 1,
        "qualificacoes": 3,
        "divida_ativa_uniao": 3,
        "divida_ativa_uniao Dívida Ativa - Geral": 3,
        "divida_ativa_uniao Dívida Ativa - Previdenciária": 0,
        "divida_ativa_uniao Dívida Ativa - FGTS": 0,
        "sancoes": 1,
        "sancoes CEIS": 1,
        "sancoes CNEP": 0,
        "sancoes CEPIM": 0,
        "divida_ativa_mg": 2,
    }


def test_universe_excludes(all_leads):
    # Simples, MEI, legal form and state take out 2, 5, 8 and 9; the branch is no row.
    assert sorted(all_leads) == ["10000001", "10000003", "10000004", "10000006", "10000007"]
    assert all_leads["10000001"].cnpj == "10000001000155"


@pytest.mark.parametrize(
    "key, regime, confidence, score, findings",
    [
        ("10000001", "Lucro Real (provável)", "Média", 40, 1),
        ("10000003", "Lucro Real (obrigatório por atividade)", "Alta", 10, 0),
        ("10000004", "Lucro Presumido (provável)", "Média", 85, 3),
        ("10000006", "Lucro Presumido (provável — ME/EPP fora do Simples)", "Baixa", 45, 2),
        ("10000007", "Lucro Real (provável)", "Média", 50, 2),
    ],
)
def test_regime_and_score(all_leads, key, regime, confidence, score, findings):
    lead = all_leads[key]
    assert (lead.regime_provavel, lead.regime_confianca) == (regime, confidence)
    assert (lead.score, lead.qtd_apontamentos) == (score, findings)


@pytest.mark.parametrize(
    "key, federal, state, text",
    [
        (
            "10000001",
            "NEGATIVA IMPROVÁVEL — inscrição em dívida ativa da União",
            "SEM APONTAMENTO NAS FONTES ABERTAS",
            "Dívida ativa da União (2 inscrições, R$ 1.599.380,85)"
            " • Débito ajuizado (execução fiscal)",
        ),
        (
            "10000003",
            "SEM APONTAMENTO NAS FONTES ABERTAS",
            "SEM APONTAMENTO NAS FONTES ABERTAS",
            "",
        ),
        (
            "10000004",
            "NEGATIVA IMPROVÁVEL — dívida ativa + inapta",
            "RISCO ALTO — cadastro inapto",
            "Dívida ativa da União (1 inscrição, R$ 97.320,00)"
            " • Débito ajuizado (execução fiscal)"
            " • Cadastro INAPTO — Extinção por encerramento liquidação voluntária"
            " • Excluída do Simples em 30/06/2023",
        ),
        (
            "10000006",
            "SEM APONTAMENTO NAS FONTES ABERTAS",
            "NEGATIVA IMPROVÁVEL — inscrição em dívida ativa estadual (MG)",
            "Dívida ativa estadual MG (1 inscrição, R$ 45.230,80 — ICMS)"
            " • Excluída do Simples em 31/01/2024",
        ),
        (
            "10000007",
            "RISCO — cadastro suspenso",
            "RISCO — cadastro suspenso",
            "Cadastro SUSPENSO — Extinção por encerramento liquidação voluntária"
            " • Sanção: CEIS",
        ),
    ],
)
def test_forecasts_and_text(all_leads, key, federal, state, text):
    lead = all_leads[key]
    assert lead.cnd_federal_prognostico == federal
    assert lead.cdt_estadual_mg_prognostico == state
    assert lead.apontamentos_texto == text


def test_details(all_leads):
    first = all_leads["10000001"]
    assert first.dau_qtd_inscricoes == 2
    assert first.dau_valor_total == 1599380.85
    assert first.dau_ajuizado is True
    assert first.tem_divida_ativa_mg is False
    assert first.situacao_irregular is False
    assert first.cnpj_formatado == "10.000.001/0001-55"
    assert first.municipio == "BELO HORIZONTE"
    assert first.cnae_descricao == "Fabricação de estruturas metálicas"
    assert first.capital_social == 5000000.0
    assert first.telefone == "(31) 33001000"
    assert all_leads["10000004"].inapta is True
    assert all_leads["10000007"].suspensa is True
    assert all_leads["10000007"].tem_sancao is True
    left = all_leads["10000006"]
    assert (left.saiu_do_simples, left.data_exclusao_simples) == (True, "20240131")
    assert (left.dam_valor_total, left.dam_especies) == (45230.8, "ICMS")


def test_stages(spark, stage):
    folder = stage[0]
    sizes = {
        name: read_stage(spark, f"{folder}/{name}").count()
        for name in ("universo", "apontamentos", "leads", "divida_ativa_mg")
    }
    assert sizes == {"universo": 5, "apontamentos": 5, "leads": 4, "divida_ativa_mg": 2}
    universe = read_stage(spark, f"{folder}/universo")
    assert len(universe.columns) == 28
    assert len(read_stage(spark, f"{folder}/apontamentos").columns) == 23
    assert len(read_stage(spark, f"{folder}/leads").columns) == 43
    # Never opted: unknown, not False.
    flags = {r.cnpj_basico: r.saiu_do_simples for r in universe.collect()}
    assert flags["10000001"] is None and flags["10000006"] is True


def test_orphan_debt_is_no_lead(spark, stage):
    folder = stage[0]
    debts = read_stage(spark, f"{folder}/divida_ativa_mg")
    assert debts.where("cnpj_basico = '99999999'").count() == 1
    assert read_stage(spark, f"{folder}/leads").where("cnpj_basico = '99999999'").count() == 0


def test_kpis(spark, stage):
    leads = read_stage(spark, f"{stage[0]}/leads")
    assert reports.kpi_summary(leads).first().asDict() == {
        "total": 4,
        "com_apontamento": 4,
        "com_divida": 2,
        "valor_divida": 1696700.85,
        "com_divida_mg": 1,
        "valor_divida_mg": 45230.8,
        "irregulares": 2,
        "sancionadas": 1,
        "ex_simples": 2,
        "lucro_real": 2,
        "lucro_presumido": 2,
    }
    top = [(r.municipio, r.total) for r in reports.top_municipalities(leads).collect()]
    assert top == [("BELO HORIZONTE", 2), ("JUIZ DE FORA", 1), ("UBERLANDIA", 1)]


def test_overview(spark, stage):
    lines = {r.indicador: r for r in pipeline.summary(spark, stage[0], PARAMS).collect()}
    assert lines["Descartadas por não terem apontamento"].quantidade == 1
    assert lines["Lucro Real provável"].texto == "2  (50.0%)"
    assert lines["Valor total em dívida ativa (União)"].texto == "R$ 1.696.700,85"


def test_export(spark, stage, tmp_path):
    path = pipeline.export(spark, stage[0], str(tmp_path), PARAMS, limit=3)
    assert path.endswith("/leads_mg")
    sheet = spark.read.options(header="true", sep=";", escape='"').csv(path)
    assert sheet.columns[:2] == ["CNPJ", "Razão social"] and len(sheet.columns) == 20
    assert [r.Score for r in sheet.collect()] == ["85", "50", "45"]
    amounts = [r["Capital social"] for r in sheet.collect()]
    assert amounts == ["300000.00", "12000000.00", "120000.00"]
    everything = pipeline.export(spark, stage[0], str(tmp_path / "all"), PARAMS)
    assert spark.read.options(header="true", sep=";").csv(everything).count() == 4


def test_sheet_files_hold_a_stated_number_of_rows(spark, stage, tmp_path):
    path = pipeline.export(spark, stage[0], str(tmp_path), PARAMS, rows_per_file=3)
    whole = pipeline.export(spark, stage[0], str(tmp_path / "whole"), PARAMS)
    files = sorted(p for p in pathlib.Path(path).iterdir() if p.suffix == ".csv")
    texts = [file.read_text().splitlines() for file in files]
    assert [len(lines) - 1 for lines in texts] == [3, 1]
    (one,) = [p for p in pathlib.Path(whole).iterdir() if p.suffix == ".csv"]
    assert one.read_text().splitlines() == [*texts[0], *texts[1][1:]]


def test_deep_pages_are_range_reads(spark, stage):
    leads = read_stage(spark, f"{stage[0]}/leads")
    wanted = [r.cnpj for r in leads.orderBy(*sort_columns(search.ORDERINGS["score"])).collect()]
    pages = []
    for number in (1, 2, 3, 1000):
        spec = search.SearchSpec(pagina=number, por_pagina=2)
        page = pipeline.page(spark, stage[0], spec)
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and page.columns == leads.columns
        pages.append([r.cnpj for r in page.collect()])
    assert pages == [wanted[:2], wanted[2:], [], []]
    other = pipeline.page(spark, stage[0], search.SearchSpec(com_divida=True, por_pagina=1))
    assert other.count() == 1


def test_stored_order_in_many_parts(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS score").repartition(13)
    keys = (("score", "desc"), ("id", "asc"))
    ordered_writer(rows, keys, ["id"], place=PLACE).parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    parts = parts_of_order(stored)
    wanted = [r.id for r in rows.orderBy(*sort_columns(keys)).collect()]
    for offset, limit in ((0, 10), (137, 400), (995, 50), (2000, 5)):
        got = slice_of_stored_order(stored, parts, offset, limit)
        assert [r.id for r in got.collect()] == wanted[offset : offset + limit]


def test_dossier_lists_are_planned_when_asked_for(spark, stage, capsys):
    group = "dossier-jobs"
    spark.sparkContext.setJobGroup(group, group)
    found = pipeline.dossier(spark, stage[0], ["10.000.001/0001-55"])
    lists = found.lists
    tracker = spark.sparkContext.statusTracker()
    assert not tracker.getJobIdsForGroup(group)
    spark.sparkContext._jsc.clearJobGroup()
    plan = lists["inscricoes_divida"]._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD" not in plan
    values = [float(r.valor_consolidado) for r in lists["inscricoes_divida"].orderBy("posicao").collect()]
    assert values == sorted(values, reverse=True) and len(values) == 2
    job.main(["--stage", stage[0], "dossier", "10000001000155", "1"])
    out = capsys.readouterr().out
    assert out.startswith("lead {") and "1 not found" in out
    assert out.count("inscricoes_divida {") == 2


def test_branches_do_not_multiply(spark, stage):
    params = PARAMS.replace(somente_matriz=False, somente_com_apontamento=False)
    rows = pipeline.build_leads(pipeline.load_tables(spark, stage[0]), params)
    assert rows.where("cnpj_basico = '10000001'").count() == 2
    assert rows.count() == 6


def test_transform_without_findings_sources(spark, stage, tmp_path):
    for table in fv.REGISTRY_LAYOUTS:
        replace_stage(read_stage(spark, f"{stage[0]}/{table}"), str(tmp_path / table))
    tables = pipeline.transform(spark, str(tmp_path), PARAMS)
    # Only status and Simples exits are left as findings.
    assert sorted(r.cnpj_basico for r in tables["leads"].collect()) == [
        "10000004",
        "10000006",
        "10000007",
    ]


def test_repeated_company_is_refused(spark, stage, tmp_path):
    for table in fv.REGISTRY_LAYOUTS:
        replace_stage(read_stage(spark, f"{stage[0]}/{table}"), str(tmp_path / table))
    again = read_stage(spark, str(tmp_path / "empresas")).where("cnpj_basico = '10000001'")
    append_stage(again, str(tmp_path / "empresas"))
    with pytest.raises(DuplicateKeys, match="empresas 10000001"):
        pipeline.transform(spark, str(tmp_path), PARAMS)


def test_job_steps(spark, stage, tmp_path, capsys):
    settings = tmp_path / "run.json"
    settings.write_text('{"uf": "mg", "universo": {"somente_com_apontamento": false}}')
    assert not job.read_settings(spark, str(settings)).somente_com_apontamento
    job.main(["--stage", stage[0], "summary"])
    assert "Descartadas por não terem apontamento: 1" in capsys.readouterr().out
    job.main(["--stage", stage[0], "export", "--folder", str(tmp_path), "--min-findings", "2"])
    path = capsys.readouterr().out.strip()
    assert spark.read.options(header="true", sep=";").csv(path).count() == 3
    with pytest.raises(ValueError, match="unknown source"):
        job.ingest(spark, "x", "y", PARAMS, AS_OF, ["other"])


def test_whole_country_is_laid_out_by_state(spark, tmp_path):
    write_landing(tmp_path)
    country = PARAMS.replace(uf=None, somente_com_apontamento=False)
    target = str(tmp_path / "stage")
    loaded = job.ingest(spark, str(tmp_path), target, country, AS_OF)
    assert loaded["estabelecimentos"] == 10 and loaded["divida_ativa_uniao"] == 4
    tables = pipeline.load_tables(spark, target)
    everywhere = pipeline.build_leads(tables, country)
    assert {r.uf: r["count"] for r in everywhere.groupBy("uf").count().collect()} == {
        "MG": 5,
        "SP": 1,
    }
    one_state = pipeline.build_leads(tables, country.replace(uf="SP"))
    assert [r.cnpj_basico for r in one_state.collect()] == ["10000009"]
    plan = one_state._jdf.queryExecution().executedPlan().toString()
    assert "= SP)]" in plan and "PartitionFilters: [isnotnull(uf#" in plan
