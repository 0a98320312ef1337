"""Federal tax debt: canonical columns, company ids only, one state or all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo import fixed_values as fv
from garimpo.functions.identity import company_key, digits, is_company_id
from garimpo.functions.money import MONEY, parse_money_br
from garimpo.sources.header_csv import read_canonical
from garimpo.sources.optional import empty_table

SCHEMA = (
    "cpf_cnpj string, cnpj_basico string, tipo_pessoa string, tipo_devedor string, "
    "nome_devedor string, uf_devedor string, unidade_responsavel string, "
    "numero_inscricao string, situacao_inscricao string, receita_principal string, "
    f"data_inscricao string, indicador_ajuizado string, valor_consolidado {MONEY}, "
    "categoria string"
)


def clean(
    raw: DataFrame, categoria: str | Column, uf: str | None, carry: Sequence[str] = ()
) -> DataFrame:
    """Debts of companies from canonical raw columns.

    Natural persons (ids without 14 digits) are dropped. With ``uf`` the debtor
    state must match after trimming and upper-casing; rows without a state stay.
    Columns of ``carry`` are handed on; rows that one of them marks ``_recusada`` stay.
    """
    id_digits = digits(F.col("cpf_cnpj"))
    label = categoria if isinstance(categoria, Column) else F.lit(categoria)
    wanted = is_company_id(id_digits)
    if uf is not None:
        state = F.col("uf_devedor")
        wanted = wanted & ((F.upper(F.trim(state)) == uf) | state.isNull())
    if "_recusada" in carry:
        wanted = wanted | F.col("_recusada")
    return raw.where(wanted).select(
        id_digits.alias("cpf_cnpj"),
        company_key(id_digits).alias("cnpj_basico"),
        "tipo_pessoa",
        "tipo_devedor",
        "nome_devedor",
        "uf_devedor",
        "unidade_responsavel",
        "numero_inscricao",
        "situacao_inscricao",
        "receita_principal",
        "data_inscricao",
        "indicador_ajuizado",
        parse_money_br(F.col("valor_consolidado")).alias("valor_consolidado"),
        label.alias("categoria"),
        *carry,
    )


def union_categories(parts: Sequence[DataFrame]) -> DataFrame:
    """One table from the cleaned categories."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def empty(spark: SparkSession) -> DataFrame:
    """Stand-in for a source that was not loaded."""
    return empty_table(spark, SCHEMA)


def read(
    spark: SparkSession, files: Mapping[str, Sequence[str]], uf: str | None
) -> DataFrame:
    """Cleaned debts from ``{category: files}``; nothing found gives no rows."""
    parts = [
        clean(raw, categoria, uf)
        for categoria, paths in files.items()
        if paths and (raw := read_canonical(spark, paths, fv.FEDERAL_DEBT_ALIASES)) is not None
    ]
    return union_categories(parts) if parts else empty(spark)
