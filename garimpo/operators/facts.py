"""Debts and sanctions summed up per company key.

Each summary is built in two steps: first per key and label, which Spark combines
before the shuffle, so a key with a third of all rows arrives as a handful of rows;
then per key, over labels only. The label lists hold distinct code values
(category, tax, register, sanction type), never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo import fixed_values as fv
from garimpo.functions.money import MONEY

KEY = "cnpj_basico"


def _distinct_list(label: Column) -> Column:
    """Sorted distinct values as one text; NULL when there is none."""
    values = F.collect_set(label)
    return F.when(
        F.size(values) > 0, F.array_join(F.sort_array(values), fv.LIST_SEPARATOR)
    )


def _sued(flag: Column) -> Column:
    return F.upper(F.coalesce(flag, F.lit(""))).startswith("S")


def _long_form(
    debts: DataFrame | None = None,
    state_debts: DataFrame | None = None,
    sanctions: DataFrame | None = None,
) -> DataFrame:
    """The three sources stacked: key, source, two labels, amount, sued flag."""
    no_text = F.lit(None).cast("string")
    no_money = F.lit(None).cast(MONEY)
    parts = []
    if debts is not None:
        parts.append(
            debts.select(
                KEY,
                F.lit("dau").alias("fonte"),
                F.col("categoria").alias("rotulo"),
                no_text.alias("tipo"),
                F.col("valor_consolidado").alias("valor"),
                _sued(F.col("indicador_ajuizado")).alias("ajuizado"),
            )
        )
    if state_debts is not None:
        parts.append(
            state_debts.select(
                KEY,
                F.lit("dam").alias("fonte"),
                F.col("especie").alias("rotulo"),
                no_text.alias("tipo"),
                F.col("saldo_cda").alias("valor"),
                F.lit(False).alias("ajuizado"),
            )
        )
    if sanctions is not None:
        parts.append(
            sanctions.select(
                KEY,
                F.lit("sancao").alias("fonte"),
                F.col("cadastro").alias("rotulo"),
                F.col("tipo_sancao").alias("tipo"),
                no_money.alias("valor"),
                F.lit(False).alias("ajuizado"),
            )
        )
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionAll(part)
    return stacked


def _per_label(stacked: DataFrame) -> DataFrame:
    return stacked.groupBy(KEY, "fonte", "rotulo", "tipo").agg(
        F.count("*").alias("linhas"),
        F.sum("valor").alias("valor"),
        F.max("ajuizado").alias("ajuizado"),
    )


def _measures(source: str) -> list[Column]:
    """Measures of one source over per-label rows of possibly several sources."""

    def only(column: str) -> Column:
        return F.when(F.col("fonte") == source, F.col(column))

    rows = F.sum(only("linhas"))
    amount = F.sum(only("valor")).cast("double")
    if source == "dau":
        return [
            rows.alias("dau_qtd_inscricoes"),
            amount.alias("dau_valor_total"),
            F.when(rows.isNotNull(), F.size(F.collect_set(only("rotulo"))).cast("long")).alias(
                "dau_qtd_categorias"
            ),
            F.max(only("ajuizado")).alias("dau_ajuizado"),
            _distinct_list(only("rotulo")).alias("dau_categorias"),
        ]
    if source == "dam":
        return [
            rows.alias("dam_qtd_inscricoes"),
            amount.alias("dam_valor_total"),
            _distinct_list(only("rotulo")).alias("dam_especies"),
        ]
    return [
        rows.alias("sancao_qtd"),
        _distinct_list(only("rotulo")).alias("sancao_cadastros"),
        _distinct_list(only("tipo")).alias("sancao_tipos"),
    ]


def debt_by_company(debts: DataFrame) -> DataFrame:
    """Federal debt: rows, sum, categories, whether any is in court."""
    return _per_label(_long_form(debts=debts)).groupBy(KEY).agg(*_measures("dau"))


def state_debt_by_company(state_debts: DataFrame) -> DataFrame:
    """State debt: rows, sum, kinds of tax."""
    return _per_label(_long_form(state_debts=state_debts)).groupBy(KEY).agg(*_measures("dam"))


def sanctions_by_company(sanctions: DataFrame) -> DataFrame:
    """Sanctions: rows, registers, types."""
    return _per_label(_long_form(sanctions=sanctions)).groupBy(KEY).agg(*_measures("sancao"))


def facts_by_company(
    debts: DataFrame, state_debts: DataFrame, sanctions: DataFrame
) -> DataFrame:
    """All three summaries, one row per company.

    The sources are stacked and summed up together: two shuffles of small rows in
    place of two per source, and one join with the companies in place of three.
    """
    return (
        _per_label(_long_form(debts, state_debts, sanctions))
        .groupBy(KEY)
        .agg(*_measures("dau"), *_measures("dam"), *_measures("sancao"))
    )
