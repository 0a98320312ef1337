"""Head offices outside the simplified tax regimes.

Everything known per company is put together first, on frames with one row per
key, and establishments join that once, at the end. Only this last join can meet a
key with many rows, and nothing after it needs the key layout, so such a key can be
split (see ``joins``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo import fixed_values as fv
from garimpo.functions.dates import drop_sentinels
from garimpo.functions.identity import blank_to_null, phone
from garimpo.functions.money import parse_decimal_comma
from garimpo.operators.joins import join_to_unique
from garimpo.operators.keyset import key_set, within
from garimpo.parameters import Parameters

# Code lists: code column of the universe, description column it gets.
LOOKUPS = {
    "municipios": ("municipio_codigo", "municipio"),
    "cnaes": ("cnae_fiscal_principal", "cnae_descricao"),
    "naturezas": ("natureza_juridica", "natureza_descricao"),
    "motivos": ("motivo_situacao_cadastral", "motivo_descricao"),
}

BASE_COLUMNS = (
    "cnpj_basico",
    "cnpj",
    "razao_social",
    "nome_fantasia",
    "identificador_matriz_filial",
    "situacao_cadastral",
    "data_situacao_cadastral",
    "motivo_situacao_cadastral",
    "data_inicio_atividade",
    "cnae_fiscal_principal",
    "cnae_fiscal_secundaria",
    "uf",
    "municipio_codigo",
    "bairro",
    "cep",
    "email",
    "telefone",
    "natureza_juridica",
    "porte_empresa",
    "capital_social",
    "simples_ativo",
    "mei_ativo",
    "saiu_do_simples",
    "data_exclusao_simples",
)

COLUMNS = BASE_COLUMNS + tuple(description for _, description in LOOKUPS.values())


def simples_status(simples: DataFrame) -> DataFrame:
    """Who is in the Simples or MEI regime, and who left Simples.

    Leaving MEI is not leaving Simples. Companies that never opted have no row here.
    """
    left_simples = drop_sentinels(F.col("data_exclusao_simples"))
    left_mei = drop_sentinels(F.col("data_exclusao_mei"))
    opted_simples = F.col("opcao_pelo_simples") == "S"
    opted_mei = F.col("opcao_mei") == "S"
    return simples.select(
        "cnpj_basico",
        "opcao_pelo_simples",
        "opcao_mei",
        left_simples.alias("data_exclusao_simples"),
        left_mei.alias("data_exclusao_mei"),
        drop_sentinels(F.col("data_opcao_simples")).alias("data_opcao_simples"),
        (opted_simples & left_simples.isNull()).alias("simples_ativo"),
        (opted_mei & left_mei.isNull()).alias("mei_ativo"),
        (opted_simples & left_simples.isNotNull()).alias("saiu_do_simples"),
    )


def companies_outside_simples(
    empresas: DataFrame, simples: DataFrame, params: Parameters
) -> DataFrame:
    """Companies of the wanted legal forms that are in neither regime; one row each."""
    status = simples_status(simples).select(
        "cnpj_basico", "simples_ativo", "mei_ativo", "saiu_do_simples", "data_exclusao_simples"
    )

    def inactive(flag: str) -> Column:
        return ~F.coalesce(F.col(flag), F.lit(False))

    return (
        empresas.where(F.col("natureza_juridica").startswith(params.prefixo_natureza_juridica))
        .select(
            "cnpj_basico",
            "razao_social",
            "natureza_juridica",
            "porte_empresa",
            parse_decimal_comma(F.col("capital_social")).alias("capital_social"),
        )
        .join(status, "cnpj_basico", "left")
        .where(inactive("simples_ativo") & inactive("mei_ativo"))
    )


def _wanted(estabelecimentos: DataFrame, params: Parameters) -> DataFrame:
    rows = estabelecimentos.where(
        F.col("situacao_cadastral").isin(*params.situacoes_cadastrais)
    )
    if params.uf is not None:
        rows = rows.where(F.col("uf") == params.uf)
    if params.somente_matriz:
        rows = rows.where(F.col("identificador_matriz_filial") == fv.HEAD_OFFICE)
    return rows


def wanted_establishments(estabelecimentos: DataFrame, params: Parameters) -> DataFrame:
    """Establishments of the state, statuses and kind the run asks for."""
    return _wanted(estabelecimentos, params).select(
        "cnpj_basico",
        F.concat("cnpj_basico", "cnpj_ordem", "cnpj_dv").alias("cnpj"),
        blank_to_null(F.col("nome_fantasia")).alias("nome_fantasia"),
        "identificador_matriz_filial",
        "situacao_cadastral",
        "data_situacao_cadastral",
        "motivo_situacao_cadastral",
        "data_inicio_atividade",
        "cnae_fiscal_principal",
        "cnae_fiscal_secundaria",
        "uf",
        F.col("municipio").alias("municipio_codigo"),
        "bairro",
        "cep",
        blank_to_null(F.col("correio_eletronico")).alias("email"),
        phone(F.col("ddd_1"), F.col("telefone_1")).alias("telefone"),
    )


def add_description(rows: DataFrame, codes: DataFrame, code: str, description: str) -> DataFrame:
    """Left join one code list.

    There is no broadcast hint: Spark broadcasts the list while its measured size is
    under ``spark.sql.autoBroadcastJoinThreshold`` and sorts and merges beyond that.
    """
    names = codes.select(
        F.col("codigo").alias(code), F.col("descricao").alias(description)
    )
    return rows.join(names, code, "left")


def enrich(rows: DataFrame, lookups: Mapping[str, DataFrame]) -> DataFrame:
    """Add the four descriptions."""
    for table, (code, description) in LOOKUPS.items():
        rows = add_description(rows, lookups[table], code, description)
    return rows


def base_rows(
    estabelecimentos: DataFrame,
    empresas: DataFrame,
    simples: DataFrame,
    params: Parameters,
    company_facts: DataFrame | None = None,
) -> DataFrame:
    """Universe rows before descriptions, with ``company_facts`` columns if given.

    A run for one state looks at the companies of that state alone: their keys, a bitmap of
    bounded size, cut the tables by company down before they are shuffled.
    """
    if params.uf is not None:
        keys = key_set(_wanted(estabelecimentos, params), "cnpj_basico")
        empresas, simples = (within(rows, "cnpj_basico", keys) for rows in (empresas, simples))
        if company_facts is not None:
            company_facts = within(company_facts, "cnpj_basico", keys)
    companies = companies_outside_simples(empresas, simples, params)
    extra: list[str] = []
    if company_facts is not None:
        companies = companies.join(company_facts, "cnpj_basico", "left")
        extra = [c for c in company_facts.columns if c != "cnpj_basico"]
    places = wanted_establishments(estabelecimentos, params)
    return join_to_unique(places, companies, "cnpj_basico").select(*BASE_COLUMNS, *extra)


def universe(
    estabelecimentos: DataFrame,
    empresas: DataFrame,
    simples: DataFrame,
    lookups: Mapping[str, DataFrame],
    params: Parameters,
) -> DataFrame:
    """The universe with its 28 columns."""
    rows = base_rows(estabelecimentos, empresas, simples, params)
    return enrich(rows, lookups).select(*COLUMNS)
