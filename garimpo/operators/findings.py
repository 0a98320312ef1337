"""Findings of each universe row: flags, certificate forecasts, readable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo import fixed_values as fv
from garimpo.functions.dates import compact_to_br
from garimpo.functions.money import format_money_br
from garimpo.operators.joins import join_to_unique

COLUMNS = (
    "cnpj_basico",
    "cnpj",
    "dau_qtd_inscricoes",
    "dau_valor_total",
    "dau_ajuizado",
    "dau_categorias",
    "tem_divida_ativa_uniao",
    "dam_qtd_inscricoes",
    "dam_valor_total",
    "dam_especies",
    "tem_divida_ativa_mg",
    "situacao_irregular",
    "inapta",
    "suspensa",
    "sancao_qtd",
    "sancao_cadastros",
    "sancao_tipos",
    "tem_sancao",
    "saiu_do_simples",
    "data_exclusao_simples",
    "cnd_federal_prognostico",
    "cdt_estadual_mg_prognostico",
    "apontamentos_texto",
)


def _forecast(has_debt: Column, with_unfit: str, debt_only: str) -> Column:
    """Certificate outlook, gravest case first."""
    unfit, suspended = F.col("inapta"), F.col("suspensa")
    return (
        F.when(has_debt & unfit, F.lit(with_unfit))
        .when(has_debt, F.lit(debt_only))
        .when(unfit, F.lit(fv.FORECAST_UNFIT))
        .when(suspended, F.lit(fv.FORECAST_SUSPENDED))
        .otherwise(F.lit(fv.FORECAST_CLEAR))
    )


def _debt_text(label: str, rows: str, amount: str, tail: Column | None = None) -> Column:
    noun = F.when(F.col(rows) == 1, F.lit(fv.TEXT_ONE_INSCRIPTION)).otherwise(
        F.lit(fv.TEXT_MANY_INSCRIPTIONS)
    )
    value = format_money_br(F.col(amount).cast("decimal(28,2)"))
    pieces = [F.lit(label), F.col(rows).cast("string"), noun, value]
    if tail is not None:
        pieces.append(_dash(tail))
    return F.concat(*pieces, F.lit(")"))


def _dash(text: Column) -> Column:
    """`` — text``, or nothing when there is no text."""
    return F.coalesce(F.concat(F.lit(fv.TEXT_DASH), text), F.lit(""))


def _readable_text() -> Column:
    """Every finding in words, in a fixed order; no finding gives an empty text."""
    left_on = F.coalesce(
        compact_to_br(F.col("data_exclusao_simples")), F.lit(fv.TEXT_UNKNOWN_DATE)
    )
    reason = _dash(F.col("motivo_descricao"))
    return F.concat_ws(
        fv.FINDING_SEPARATOR,
        F.when(
            F.col("tem_divida_ativa_uniao"),
            _debt_text(fv.TEXT_FEDERAL_DEBT, "dau_qtd_inscricoes", "dau_valor_total"),
        ),
        F.when(F.col("dau_ajuizado"), F.lit(fv.TEXT_SUED)),
        F.when(
            F.col("tem_divida_ativa_mg"),
            _debt_text(
                fv.TEXT_STATE_DEBT, "dam_qtd_inscricoes", "dam_valor_total", F.col("dam_especies")
            ),
        ),
        F.when(F.col("inapta"), F.concat(F.lit(fv.TEXT_UNFIT), reason)),
        F.when(F.col("suspensa"), F.concat(F.lit(fv.TEXT_SUSPENDED), reason)),
        F.when(F.col("tem_sancao"), F.concat(F.lit(fv.TEXT_SANCTION), F.col("sancao_cadastros"))),
        F.when(F.col("saiu_do_simples"), F.concat(F.lit(fv.TEXT_LEFT_SIMPLES), left_on)),
    )


def add_findings(rows: DataFrame) -> DataFrame:
    """Finding columns for universe rows that carry the company facts.

    Works row by row: an establishment never multiplies with another one of the
    same company, also when branches are included.
    """
    status = F.col("situacao_cadastral")
    flags = rows.withColumns(
        {
            "tem_divida_ativa_uniao": F.col("dau_qtd_inscricoes").isNotNull(),
            "tem_divida_ativa_mg": F.col("dam_qtd_inscricoes").isNotNull(),
            "tem_sancao": F.col("sancao_qtd").isNotNull(),
            "situacao_irregular": status != fv.STATUS_ACTIVE,
            "inapta": status == fv.STATUS_UNFIT,
            "suspensa": status == fv.STATUS_SUSPENDED,
            "saiu_do_simples": F.coalesce("saiu_do_simples", F.lit(False)),
            "dau_ajuizado": F.coalesce("dau_ajuizado", F.lit(False)),
        }
    ).withColumns(
        {
            "dau_qtd_inscricoes": F.coalesce("dau_qtd_inscricoes", F.lit(0).cast("long")),
            "dau_valor_total": F.coalesce("dau_valor_total", F.lit(0.0)),
            "dam_qtd_inscricoes": F.coalesce("dam_qtd_inscricoes", F.lit(0).cast("long")),
            "dam_valor_total": F.coalesce("dam_valor_total", F.lit(0.0)),
            "sancao_qtd": F.coalesce("sancao_qtd", F.lit(0).cast("long")),
        }
    )
    return flags.withColumns(
        {
            "cnd_federal_prognostico": _forecast(
                F.col("tem_divida_ativa_uniao"),
                fv.FORECAST_FEDERAL_DEBT_UNFIT,
                fv.FORECAST_FEDERAL_DEBT,
            ),
            "cdt_estadual_mg_prognostico": _forecast(
                F.col("tem_divida_ativa_mg"),
                fv.FORECAST_STATE_DEBT_UNFIT,
                fv.FORECAST_STATE_DEBT,
            ),
            "apontamentos_texto": _readable_text(),
        }
    )


def findings(universe: DataFrame, company_facts: DataFrame) -> DataFrame:
    """The findings table: one row per universe row, 23 columns."""
    rows = join_to_unique(universe, company_facts, "cnpj_basico", "left")
    return add_findings(rows).select(*COLUMNS)
