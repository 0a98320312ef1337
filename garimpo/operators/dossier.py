"""Everything on file about given leads.

A dossier is the lead row plus four ordered lists. Each list is a flat DataFrame with
one row per entry and its position within the company, not an array in the lead row:
one company may own a large part of a source, and such a list fits in no single row
or task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.dates import date_br
from garimpo.functions.identity import digits
from garimpo.functions.money import MONEY
from garimpo.operators.joins import join_to_unique
from garimpo.operators.ordering import SortKey, positions_of_looked_up, with_position

KEY = "cnpj_basico"

FEDERAL_COLUMNS = (
    "categoria",
    "situacao_inscricao",
    "receita_principal",
    "data_inscricao",
    "indicador_ajuizado",
    "valor_consolidado",
    "unidade_responsavel",
)
STATE_COLUMNS = ("numero_cda", "data_inscricao", "especie", "saldo_cda", "saldo_nucleo")
SANCTION_COLUMNS = (
    "cadastro",
    "tipo_sancao",
    "data_inicio",
    "data_fim",
    "orgao_sancionador",
    "fundamentacao",
)
PARTNER_COLUMNS = ("nome", "qualificacao", "data_entrada_sociedade", "faixa_etaria")

FEDERAL_ORDER: tuple[SortKey, ...] = (("valor_consolidado", "desc"),)
STATE_ORDER: tuple[SortKey, ...] = (("saldo_cda", "desc"),)


@dataclass(frozen=True)
class Dossier:
    """The lead rows and their four lists; each list is planned when it is asked for."""

    lead: DataFrame
    debts: DataFrame
    state_debts: DataFrame
    sanctions: DataFrame
    partners: DataFrame
    qualifications: DataFrame

    @property
    def inscricoes_divida(self) -> DataFrame:
        return _looked_up(self.lead, self.debts, FEDERAL_COLUMNS, FEDERAL_ORDER)

    @property
    def inscricoes_divida_mg(self) -> DataFrame:
        return _looked_up(self.lead, self.state_debts, STATE_COLUMNS, STATE_ORDER)

    @property
    def sancoes(self) -> DataFrame:
        return _looked_up(self.lead, self.sanctions, SANCTION_COLUMNS)

    @property
    def socios(self) -> DataFrame:
        named = named_partners(self.partners, self.qualifications)
        return _looked_up(self.lead, named, PARTNER_COLUMNS)

    @property
    def lists(self) -> dict[str, DataFrame]:
        names = ("inscricoes_divida", "inscricoes_divida_mg", "sancoes", "socios")
        return {name: getattr(self, name) for name in names}


def _bare(cnpjs: Sequence[str]) -> list[str]:
    return ["".join(c for c in cnpj if c in "0123456789") for cnpj in cnpjs]


def find_leads(leads: DataFrame, cnpjs: Sequence[str]) -> DataFrame:
    """Leads with the given ids, written with or without punctuation."""
    return leads.where(F.col("cnpj").isin(*_bare(cnpjs)))


def of_companies(children: DataFrame, cnpjs: Sequence[str]) -> DataFrame:
    """Entries of the companies of the given ids.

    The keys are literals, so they reach the scan: a stage ordered by company is read
    where those companies stand.
    """
    return children.where(F.col(KEY).isin(*sorted({cnpj[:8] for cnpj in _bare(cnpjs)})))


def not_found(leads: DataFrame, wanted: DataFrame, cnpj: str = "cnpj") -> DataFrame:
    """Ids of ``wanted`` that are no lead."""
    ids = wanted.select(F.col(cnpj).alias("procurado"), digits(F.col(cnpj)).alias("cnpj"))
    return ids.join(leads.select("cnpj"), "cnpj", "left_anti").select("procurado")


def _mark_copies(children: DataFrame) -> DataFrame:
    """Tell exact copies apart by where they stand in the scan.

    With that at the end of the sort key, many copies of one entry also spread over
    tasks. Taken before any join, so a repeated task marks its rows the same way.
    """
    return children.withColumn("_copia", F.monotonically_increasing_id())


def _entries(
    owners: DataFrame,
    children: DataFrame,
    columns: Sequence[str],
    first: Sequence[SortKey] = (),
) -> DataFrame:
    """Entries of the owners' companies with their position.

    Ordered by ``first``, then by every other column, then as marked by
    :func:`_mark_copies`.
    """
    keys = [*_full_order(columns, first), ("_copia", "asc")]
    own = children.select(KEY, *columns, "_copia").join(owners.select(KEY), KEY, "left_semi")
    return with_position(own, keys, by=[KEY]).select(KEY, "posicao", *columns)


def _full_order(columns: Sequence[str], first: Sequence[SortKey]) -> list[SortKey]:
    led = [name for name, _ in first]
    return [*first, *((name, "asc") for name in columns if name not in led)]


def _looked_up(
    owners: DataFrame,
    children: DataFrame,
    columns: Sequence[str],
    first: Sequence[SortKey] = (),
) -> DataFrame:
    """The same for the entries of a few companies, nothing written in between."""
    own = children.select(KEY, *columns).join(owners.select(KEY), KEY, "left_semi")
    placed = positions_of_looked_up(own, _full_order(columns, first), KEY)
    return placed.select(KEY, "posicao", *columns)


def federal_entries(owners: DataFrame, debts: DataFrame) -> DataFrame:
    """Federal inscriptions, largest value first."""
    return _entries(owners, _mark_copies(debts), FEDERAL_COLUMNS, FEDERAL_ORDER)


def state_entries(owners: DataFrame, state_debts: DataFrame) -> DataFrame:
    """State inscriptions, largest balance first."""
    return _entries(owners, _mark_copies(state_debts), STATE_COLUMNS, STATE_ORDER)


def sanction_entries(owners: DataFrame, sanctions: DataFrame) -> DataFrame:
    return _entries(owners, _mark_copies(sanctions), SANCTION_COLUMNS)


def named_partners(partners: DataFrame, qualifications: DataFrame) -> DataFrame:
    """Partners with the text of their qualification; an unknown code has none."""
    names = qualifications.select(
        F.col("codigo").alias("qualificacao_socio"), F.col("descricao").alias("qualificacao")
    )
    return partners.join(names, "qualificacao_socio", "left").withColumn(
        "nome", F.col("nome_socio_razao_social")
    )


def partner_entries(
    owners: DataFrame, partners: DataFrame, qualifications: DataFrame
) -> DataFrame:
    named = named_partners(_mark_copies(partners), qualifications)
    return _entries(owners, named, PARTNER_COLUMNS)


def dossier(
    leads: DataFrame,
    cnpjs: Sequence[str],
    debts: DataFrame,
    state_debts: DataFrame,
    sanctions: DataFrame,
    partners: DataFrame,
    qualifications: DataFrame,
) -> Dossier:
    """Dossier of the leads with the given ids; every source is looked up, not read whole."""
    return Dossier(
        find_leads(leads, cnpjs),
        of_companies(debts, cnpjs),
        of_companies(state_debts, cnpjs),
        of_companies(sanctions, cnpjs),
        of_companies(partners, cnpjs),
        qualifications,
    )


def overview(
    owners: DataFrame,
    debts: DataFrame,
    state_debts: DataFrame,
    sanctions: DataFrame,
    partners: DataFrame,
    qualifications: DataFrame,
) -> DataFrame:
    """One row per lead: size of each list and the largest amounts.

    The four sources are stacked and counted together: one hash aggregate combined
    before the shuffle, and one join with the leads.
    """
    no_money = F.lit(None).cast(MONEY)
    no_text = F.lit(None).cast("string")
    stacked = (
        debts.select(KEY, F.lit("dau").alias("fonte"), F.col("valor_consolidado").alias("valor"))
        .unionAll(state_debts.select(KEY, F.lit("dam"), "saldo_cda"))
        .withColumn("qualificacao", no_text)
        .unionAll(sanctions.select(KEY, F.lit("sancao"), no_money, no_text))
        .unionAll(
            named_partners(partners, qualifications).select(
                KEY, F.lit("socio"), no_money, "qualificacao"
            )
        )
    )

    def rows_of(source: str) -> Column:
        return F.count_if(F.col("fonte") == source)

    def largest(source: str) -> Column:
        return F.max(F.when(F.col("fonte") == source, F.col("valor"))).cast("double")

    lists = stacked.groupBy(KEY).agg(
        rows_of("dau").alias("qtd_inscricoes_divida"),
        largest("dau").alias("maior_divida"),
        rows_of("dam").alias("qtd_inscricoes_divida_mg"),
        largest("dam").alias("maior_divida_mg"),
        rows_of("sancao").alias("qtd_sancoes"),
        rows_of("socio").alias("qtd_socios"),
        F.count("qualificacao").alias("qtd_socios_qualificados"),
    )
    counts = [name for name in lists.columns if name.startswith("qtd_")]
    named = owners.select(KEY, "cnpj", "razao_social", "data_inicio_atividade")
    return (
        join_to_unique(named, lists, KEY, "left")
        .fillna(0, counts)
        .withColumn("inicio_atividade", date_br(F.col("data_inicio_atividade")))
        .drop(KEY, "data_inicio_atividade")
    )
