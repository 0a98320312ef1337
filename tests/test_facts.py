"""Facts and findings where labels, amounts or dates are missing."""

from __future__ import annotations

from decimal import Decimal

from garimpo import fixed_values as fv
from garimpo.operators import facts, findings
from garimpo.sources import federal_debt, sanctions, state_debt


def table(spark, source, records):
    """Rows of a source table from partial records; the rest is NULL."""
    names = source.empty(spark).columns
    return spark.createDataFrame([[r.get(n) for n in names] for r in records], source.SCHEMA)


def company_facts(spark):
    debts = table(
        spark,
        federal_debt,
        [
            {"cnpj_basico": "1", "valor_consolidado": Decimal("1.10"), "categoria": "B"},
            {"cnpj_basico": "1", "valor_consolidado": Decimal("2.20"), "categoria": "A",
             "indicador_ajuizado": "SIM"},
            {"cnpj_basico": "1", "categoria": "A", "indicador_ajuizado": "Não"},
            {"cnpj_basico": "2"},
        ],
    )
    state_debts = table(
        spark, state_debt, [{"cnpj_basico": "2", "saldo_cda": Decimal("10.00")}]
    )
    registers = table(
        spark,
        sanctions,
        [
            {"cnpj_basico": "2", "tipo_sancao": "Multa"},
            {"cnpj_basico": "3", "cadastro": "CNEP"},
            {"cnpj_basico": "3", "cadastro": "CEIS", "tipo_sancao": "Multa"},
        ],
    )
    return debts, state_debts, registers


def test_summaries(spark):
    debts, state_debts, registers = company_facts(spark)
    first, second = facts.debt_by_company(debts).orderBy("cnpj_basico").collect()
    assert first.asDict() == {
        "cnpj_basico": "1",
        "dau_qtd_inscricoes": 3,
        "dau_valor_total": 3.3,
        "dau_qtd_categorias": 2,
        "dau_ajuizado": True,
        "dau_categorias": "A | B",
    }
    assert (second.dau_qtd_inscricoes, second.dau_valor_total) == (1, None)
    assert (second.dau_qtd_categorias, second.dau_categorias) == (0, None)
    assert second.dau_ajuizado is False
    (state,) = facts.state_debt_by_company(state_debts).collect()
    assert (state.dam_qtd_inscricoes, state.dam_especies) == (1, None)
    two, three = facts.sanctions_by_company(registers).orderBy("cnpj_basico").collect()
    assert (two.sancao_cadastros, two.sancao_tipos) == (None, "Multa")
    assert (three.sancao_qtd, three.sancao_cadastros) == (2, "CEIS | CNEP")


def test_together_equals_one_by_one(spark):
    debts, state_debts, registers = company_facts(spark)
    together = facts.facts_by_company(debts, state_debts, registers)
    for alone in (
        facts.debt_by_company(debts),
        facts.state_debt_by_company(state_debts),
        facts.sanctions_by_company(registers),
    ):
        counted = alone.columns[1]
        part = together.where(f"{counted} IS NOT NULL").select(*alone.columns)
        assert sorted(map(str, part.collect())) == sorted(map(str, alone.collect()))


def test_texts_without_labels(spark):
    universe = spark.createDataFrame(
        [
            ("1", "1", "02", None, None, None),
            ("2", "2", "04", True, None, None),
            ("3", "3", "03", False, "20240131", "motivo"),
            ("4", "4", "02", None, None, None),
        ],
        "cnpj_basico string, cnpj string, situacao_cadastral string, saiu_do_simples boolean, "
        "data_exclusao_simples string, motivo_descricao string",
    )
    found = findings.findings(universe, facts.facts_by_company(*company_facts(spark)))
    rows = {r.cnpj: r for r in found.collect()}
    assert rows["1"].apontamentos_texto == (
        "Dívida ativa da União (3 inscrições, R$ 3,30) • Débito ajuizado (execução fiscal)"
    )
    # No amount, no kind of tax, no reason, no register, no date.
    assert rows["2"].apontamentos_texto == (
        "Dívida ativa da União (1 inscrição, R$ 0,00)"
        " • Dívida ativa estadual MG (1 inscrição, R$ 10,00)"
        " • Cadastro INAPTO • Excluída do Simples em ?"
    )
    assert rows["2"].tem_sancao is True and rows["2"].dau_valor_total == 0.0
    assert rows["2"].cdt_estadual_mg_prognostico == fv.FORECAST_STATE_DEBT_UNFIT
    assert rows["3"].apontamentos_texto == (
        "Cadastro SUSPENSO — motivo • Sanção: CEIS | CNEP"
    )
    assert rows["4"].apontamentos_texto == "" and rows["4"].saiu_do_simples is False
    assert rows["4"].dam_qtd_inscricoes == 0 and rows["4"].sancao_cadastros is None
