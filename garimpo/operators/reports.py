"""KPI rows and rankings over ``leads``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo import fixed_values as fv
from garimpo.functions.money import format_reais, format_thousands

TOP_MUNICIPALITIES = 15


def _amount(column: Column) -> Column:
    """Exact sum of an amount column; 0 when there are no rows."""
    return F.coalesce(F.sum(column.cast("decimal(28,2)")).cast("double"), F.lit(0.0))


def _regime(prefix: str) -> Column:
    return F.count_if(F.col("regime_provavel").startswith(prefix))


def kpi_summary(leads: DataFrame) -> DataFrame:
    """One row with the eleven headline numbers, in one pass."""
    return leads.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("qtd_apontamentos") > 0).alias("com_apontamento"),
        F.count_if("tem_divida_ativa_uniao").alias("com_divida"),
        _amount(F.col("dau_valor_total")).alias("valor_divida"),
        F.count_if("tem_divida_ativa_mg").alias("com_divida_mg"),
        _amount(F.col("dam_valor_total")).alias("valor_divida_mg"),
        F.count_if("situacao_irregular").alias("irregulares"),
        F.count_if("tem_sancao").alias("sancionadas"),
        F.count_if("saiu_do_simples").alias("ex_simples"),
        _regime(fv.REGIME_REAL_PREFIX).alias("lucro_real"),
        _regime(fv.REGIME_PRESUMED_PREFIX).alias("lucro_presumido"),
    )


def share(part: Column, total: Column) -> Column:
    """Part of the total, NULL when the total is 0."""
    return F.try_divide(part, total)


def share_text(part: Column, total: Column) -> Column:
    """Share for a dashboard tile, e.g. ``12,5% do universo``; a dash if the total is 0.

    Tenths of a percent are rounded half up on whole numbers, so no binary fraction
    decides a tie.
    """
    tenths = F.floor(F.try_divide(part * 2000 + total, total * 2))
    text = F.concat(
        F.floor(tenths / 10).cast("string"),
        F.lit(","),
        (tenths % 10).cast("string"),
        F.lit(fv.SHARE_SUFFIX),
    )
    return F.coalesce(text, F.lit(fv.EMPTY_MARK))


def kpi_shares(leads: DataFrame) -> DataFrame:
    """Share of the total for each counted KPI: (indicador, valor, participacao, texto)."""
    counted = (
        "com_apontamento",
        "com_divida",
        "com_divida_mg",
        "irregulares",
        "sancionadas",
        "ex_simples",
        "lucro_real",
        "lucro_presumido",
    )
    long = kpi_summary(leads).unpivot("total", list(counted), "indicador", "valor")
    return long.select(
        "indicador",
        "valor",
        share(F.col("valor"), F.col("total")).alias("participacao"),
        share_text(F.col("valor"), F.col("total")).alias("texto"),
    )


def _count_with_share(part: Column, total: Column) -> Column:
    """``1.234  (12.3%)``; only the number when the total is 0."""
    percent = F.format_number(F.try_divide(part, total) * 100, 1)
    tail = F.concat(F.lit("  ("), percent, F.lit("%)"))
    return F.concat(format_thousands(part), F.coalesce(tail, F.lit("")))


def panorama(universe: DataFrame, leads: DataFrame, only_with_finding: bool) -> DataFrame:
    """Overview lines: (ordem, indicador, quantidade, valor, texto).

    ``quantidade`` is set on counting lines, ``valor`` on money lines. With the
    findings cut on, the first lines relate leads to the whole universe.
    """
    in_universe = universe.agg(F.count("*")).scalar()
    row = kpi_summary(leads).withColumn("universo", in_universe)
    total = F.col("total")

    def plain(title: str, number: Column) -> tuple[str, Column, None, Column]:
        return title, number, None, format_thousands(number)

    def counted(title: str, name: str) -> tuple[str, Column, None, Column]:
        return title, F.col(name), None, _count_with_share(F.col(name), total)

    def money(title: str, name: str) -> tuple[str, None, Column, Column]:
        return title, None, F.col(name), format_reais(F.col(name).cast("decimal(28,2)"))

    if only_with_finding:
        head = [
            plain(fv.OVERVIEW_UNIVERSE_RAW, F.col("universo")),
            plain(fv.OVERVIEW_BECOME_LEADS, total),
            plain(fv.OVERVIEW_DISCARDED, F.col("universo") - total),
        ]
    else:
        head = [
            counted(fv.OVERVIEW_UNIVERSE_TOTAL, "total"),
            counted(fv.OVERVIEW_WITH_FINDING, "com_apontamento"),
        ]
    lines = [
        *head,
        counted(fv.OVERVIEW_REAL, "lucro_real"),
        counted(fv.OVERVIEW_PRESUMED, "lucro_presumido"),
        counted(fv.OVERVIEW_FEDERAL_DEBT, "com_divida"),
        money(fv.OVERVIEW_FEDERAL_VALUE, "valor_divida"),
        counted(fv.OVERVIEW_STATE_DEBT, "com_divida_mg"),
        money(fv.OVERVIEW_STATE_VALUE, "valor_divida_mg"),
        counted(fv.OVERVIEW_IRREGULAR, "irregulares"),
        counted(fv.OVERVIEW_SANCTIONED, "sancionadas"),
        counted(fv.OVERVIEW_LEFT_SIMPLES, "ex_simples"),
    ]
    as_rows = [
        F.struct(
            F.lit(number).alias("ordem"),
            F.lit(title).alias("indicador"),
            (F.lit(None).cast("long") if count is None else count).alias("quantidade"),
            (F.lit(None).cast("double") if amount is None else amount).alias("valor"),
            text.alias("texto"),
        )
        for number, (title, count, amount, text) in enumerate(lines, start=1)
    ]
    return row.select(F.inline(F.array(*as_rows)))


def top_municipalities(leads: DataFrame, limit: int = TOP_MUNICIPALITIES) -> DataFrame:
    """Municipalities with most leads; ties by name."""
    return (
        leads.where(F.col("municipio").isNotNull())
        .groupBy("municipio")
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("qtd_apontamentos") > 0).alias("com_apontamento"),
        )
        .orderBy(F.desc("total"), "municipio")
        .limit(limit)
    )


def by_regime(leads: DataFrame) -> DataFrame:
    """Leads per regime, most first."""
    return (
        leads.groupBy(F.col("regime_provavel").alias("regime"))
        .agg(F.count("*").alias("total"))
        .orderBy(F.desc("total"), "regime")
    )


def municipality_list(leads: DataFrame) -> DataFrame:
    """Names of municipalities with leads, in order."""
    return (
        leads.where(F.col("municipio").isNotNull())
        .select("municipio")
        .distinct()
        .orderBy("municipio")
    )


def relative_to_max(ranking: DataFrame, value: str = "total") -> DataFrame:
    """Value of each group in percent of the largest group.

    The largest is a scalar subquery, so rows of a ranking of any size stay where they are.
    """
    largest = ranking.agg(F.max(value)).scalar()
    percent = F.coalesce(F.try_divide(F.col(value), largest) * 100, F.lit(0.0))
    return ranking.withColumn("percentual_do_maior", percent)
