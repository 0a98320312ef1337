"""Probable tax regime, score and the final ``leads`` table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo import fixed_values as fv
from garimpo.functions.identity import format_cnpj
from garimpo.functions.money import format_reais_rounded
from garimpo.parameters import Parameters, ScoreWeights

COLUMNS = (
    "cnpj",
    "cnpj_basico",
    "cnpj_formatado",
    "razao_social",
    "nome_fantasia",
    "municipio",
    "uf",
    "bairro",
    "cep",
    "telefone",
    "email",
    "cnae_fiscal_principal",
    "cnae_descricao",
    "natureza_descricao",
    "porte",
    "capital_social",
    "situacao",
    "motivo_descricao",
    "data_inicio_atividade",
    "regime_provavel",
    "regime_confianca",
    "tem_divida_ativa_uniao",
    "dau_qtd_inscricoes",
    "dau_valor_total",
    "dau_ajuizado",
    "dau_categorias",
    "tem_divida_ativa_mg",
    "dam_qtd_inscricoes",
    "dam_valor_total",
    "dam_especies",
    "situacao_irregular",
    "inapta",
    "suspensa",
    "tem_sancao",
    "sancao_cadastros",
    "sancao_tipos",
    "saiu_do_simples",
    "data_exclusao_simples",
    "cnd_federal_prognostico",
    "cdt_estadual_mg_prognostico",
    "apontamentos_texto",
    "score",
    "qtd_apontamentos",
)

FINDING_FLAGS = (
    "tem_divida_ativa_uniao",
    "tem_divida_ativa_mg",
    "situacao_irregular",
    "tem_sancao",
    "saiu_do_simples",
)


def _mandatory_activity() -> Column:
    return F.substring("cnae_fiscal_principal", 1, 4).isin(*fv.MANDATORY_LUCRO_REAL_ACTIVITIES)


def _large() -> Column:
    return F.col("porte_empresa") == fv.SIZE_OTHERS


def _small() -> Column:
    return F.col("porte_empresa").isin(*fv.SIZE_SMALL)


def probable_regime(capital_threshold: int) -> Column:
    """Inferred regime, strongest sign first. Unknown capital counts as below."""
    return (
        F.when(_mandatory_activity(), F.lit(fv.REGIME_MANDATORY))
        .when(_large() & (F.col("capital_social") >= capital_threshold), F.lit(fv.REGIME_REAL))
        .when(_large(), F.lit(fv.REGIME_PRESUMED))
        .when(_small(), F.lit(fv.REGIME_PRESUMED_SMALL))
        .otherwise(F.lit(fv.REGIME_UNKNOWN))
    )


def regime_confidence() -> Column:
    return (
        F.when(_mandatory_activity(), F.lit(fv.CONFIDENCE_HIGH))
        .when(_large(), F.lit(fv.CONFIDENCE_MEDIUM))
        .when(_small(), F.lit(fv.CONFIDENCE_LOW))
        .otherwise(F.lit(fv.CONFIDENCE_NONE))
    )


def _decode(code: str, names: Mapping[str, str]) -> Column:
    """Code to name; an unknown code is NULL."""
    pairs = [F.lit(part) for pair in names.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(code))


def _points(flag: Column, points: int) -> Column:
    return F.when(flag, F.lit(points)).otherwise(F.lit(0))


def score(weights: ScoreWeights) -> Column:
    """Weighted sum of the signals, at most 100."""
    total = (
        _points(F.col("tem_divida_ativa_uniao"), weights.divida_ativa_uniao)
        + _points(F.col("tem_divida_ativa_mg"), weights.divida_ativa_mg)
        + _points(F.col("situacao_irregular"), weights.situacao_irregular)
        + _points(F.col("tem_sancao"), weights.sancao)
        + _points(F.col("saiu_do_simples"), weights.saiu_do_simples)
        + _points(_large(), weights.porte_demais)
    )
    return F.least(F.lit(100), total)


def finding_count() -> Column:
    """How many of the five kinds of finding a row has."""
    first, *rest = [_points(F.col(flag), 1) for flag in FINDING_FLAGS]
    for term in rest:
        first = first + term
    return first


def leads(rows: DataFrame, params: Parameters) -> DataFrame:
    """The 43-column ``leads`` table from universe rows with findings.

    Regime, score and texts depend on their own row only, so nothing is joined. With
    ``somente_com_apontamento`` only rows with a finding remain.
    """
    complete = rows.withColumns(
        {
            "cnpj_formatado": format_cnpj(F.col("cnpj")),
            "porte": _decode("porte_empresa", fv.SIZE_NAMES),
            "situacao": _decode("situacao_cadastral", fv.STATUS_NAMES),
            "regime_provavel": probable_regime(params.capital_lucro_real),
            "regime_confianca": regime_confidence(),
            "score": score(params.weights),
            "qtd_apontamentos": finding_count(),
        }
    )
    if params.somente_com_apontamento:
        complete = complete.where(F.col("qtd_apontamentos") > 0)
    return complete.select(*COLUMNS)


def lead_tags() -> Column:
    """Tags of a lead as an array of (severity, text), at most seven."""

    def tag(flag: str, pair: tuple[str, str], tail: Column | None = None) -> Column:
        severity, text = pair
        label = F.lit(text) if tail is None else F.concat(F.lit(text), tail)
        return F.when(
            F.col(flag), F.struct(F.lit(severity).alias("gravidade"), label.alias("texto"))
        )

    tags = F.filter(
        F.array(
            tag(
                "tem_divida_ativa_uniao",
                fv.TAG_FEDERAL_DEBT,
                format_reais_rounded(F.coalesce("dau_valor_total", F.lit(0.0))),
            ),
            tag("dau_ajuizado", fv.TAG_SUED),
            tag(
                "tem_divida_ativa_mg",
                fv.TAG_STATE_DEBT,
                format_reais_rounded(F.coalesce("dam_valor_total", F.lit(0.0))),
            ),
            tag("inapta", fv.TAG_UNFIT),
            tag("suspensa", fv.TAG_SUSPENDED),
            tag("tem_sancao", fv.TAG_SANCTION, F.coalesce("sancao_cadastros", F.lit(""))),
            tag("saiu_do_simples", fv.TAG_LEFT_SIMPLES),
        ),
        lambda item: item.isNotNull(),
    )
    severity, text = fv.TAG_NONE
    none = F.array(F.struct(F.lit(severity).alias("gravidade"), F.lit(text).alias("texto")))
    return F.when(F.size(tags) > 0, tags).otherwise(none)
