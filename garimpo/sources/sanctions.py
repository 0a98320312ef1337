"""Sanction registers: canonical columns, company ids only.

Neither the state nor the end date filters: an expired sanction still counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo import fixed_values as fv
from garimpo.functions.identity import company_key, digits, is_company_id
from garimpo.sources.header_csv import read_canonical
from garimpo.sources.optional import empty_table

SCHEMA = (
    "cpf_cnpj string, cnpj_basico string, cadastro string, nome string, "
    "tipo_sancao string, data_inicio string, data_fim string, "
    "orgao_sancionador string, uf string, fundamentacao string"
)


def clean(raw: DataFrame, cadastro: str | Column, carry: Sequence[str] = ()) -> DataFrame:
    """Sanctions of companies from canonical raw columns.

    Columns of ``carry`` are handed on; rows that one of them marks ``_recusada`` stay.
    """
    id_digits = digits(F.col("cpf_cnpj"))
    label = cadastro if isinstance(cadastro, Column) else F.lit(cadastro)
    wanted = is_company_id(id_digits)
    if "_recusada" in carry:
        wanted = wanted | F.col("_recusada")
    return raw.where(wanted).select(
        id_digits.alias("cpf_cnpj"),
        company_key(id_digits).alias("cnpj_basico"),
        label.alias("cadastro"),
        "nome",
        "tipo_sancao",
        "data_inicio",
        "data_fim",
        "orgao_sancionador",
        "uf",
        "fundamentacao",
        *carry,
    )


def union_registers(parts: Sequence[DataFrame]) -> DataFrame:
    """One table from the cleaned registers."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def empty(spark: SparkSession) -> DataFrame:
    """Stand-in for a source that was not loaded."""
    return empty_table(spark, SCHEMA)


def read(spark: SparkSession, files: Mapping[str, Sequence[str]]) -> DataFrame:
    """Cleaned sanctions from ``{register: files}``; nothing found gives no rows."""
    parts = [
        clean(raw, cadastro)
        for cadastro, paths in files.items()
        if paths and (raw := read_canonical(spark, paths, fv.SANCTION_ALIASES)) is not None
    ]
    return union_registers(parts) if parts else empty(spark)
