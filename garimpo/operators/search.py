"""Filtered, ordered and paged search over ``leads``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo import fixed_values as fv
from garimpo.operators.ordering import SortKey, slice_of_order, slice_of_stored_order

TIE_BREAK: SortKey = ("cnpj", "asc")

ORDERINGS: dict[str, tuple[SortKey, ...]] = {
    "score": (("score", "desc"), ("dau_valor_total", "desc"), TIE_BREAK),
    "divida": (("dau_valor_total", "desc"), TIE_BREAK),
    "divida_mg": (("dam_valor_total", "desc"), TIE_BREAK),
    "capital": (("capital_social", "desc"), TIE_BREAK),
    "razao_social": (("razao_social", "asc"), TIE_BREAK),
}

#: The order that leads are stored in.
STORED_ORDER = "score"

PAGE_SIZE_LIMIT = 500

_REGIME_PREFIXES = {"real": fv.REGIME_REAL_PREFIX, "presumido": fv.REGIME_PRESUMED_PREFIX}


@dataclass(frozen=True)
class SearchSpec:
    """One search. Filters left at None or empty do not filter."""

    busca: str | None = None
    municipio: str | None = None
    regime: str | None = None
    com_divida: bool | None = None
    com_divida_mg: bool | None = None
    irregular: bool | None = None
    com_sancao: bool | None = None
    ex_simples: bool | None = None
    score_minimo: int = 0
    ordenar: str = "score"
    pagina: int = 1
    por_pagina: int = 50

    def __post_init__(self) -> None:
        if self.ordenar not in ORDERINGS:
            raise ValueError(f"unknown order {self.ordenar!r}; one of {', '.join(ORDERINGS)}")
        if self.pagina < 1:
            raise ValueError("pagina starts at 1")
        if not 1 <= self.por_pagina <= PAGE_SIZE_LIMIT:
            raise ValueError(f"por_pagina is 1 to {PAGE_SIZE_LIMIT}")

    @property
    def unfiltered(self) -> bool:
        """Does the search ask for all leads? (No lead has a score below 0.)"""
        bare = SearchSpec(ordenar=self.ordenar, pagina=self.pagina, por_pagina=self.por_pagina)
        return replace(self, score_minimo=max(self.score_minimo, 0)) == bare

    @property
    def offset(self) -> int:
        return (self.pagina - 1) * self.por_pagina


def text_matches(text: str) -> Column:
    """Name or trade name contains the text, or the id contains its digits.

    Case does not matter; ``%`` and ``_`` are wildcards. A text without digits does
    not look at ids.
    """
    # LIKE needs some escape character; one that is not in the text leaves the text as is.
    escape = next(c for c in map(chr, range(1, len(text) + 2)) if c not in text)
    pattern, escape_col = F.lit(f"%{text}%"), F.lit(escape)
    options = [
        F.ilike(F.col(name), pattern, escape_col) for name in ("razao_social", "nome_fantasia")
    ]
    if found := "".join(c for c in text if c.isdigit()):
        options.append(F.col("cnpj").contains(found))
    return reduce(or_, options)


def _conditions(spec: SearchSpec) -> Iterator[Column]:
    yield F.col("score") >= spec.score_minimo
    if spec.busca:
        yield text_matches(spec.busca)
    if spec.municipio:
        yield F.col("municipio") == spec.municipio
    if spec.regime in _REGIME_PREFIXES:
        yield F.col("regime_provavel").startswith(_REGIME_PREFIXES[spec.regime])
    flags = {
        "tem_divida_ativa_uniao": spec.com_divida,
        "tem_divida_ativa_mg": spec.com_divida_mg,
        "situacao_irregular": spec.irregular,
        "tem_sancao": spec.com_sancao,
        "saiu_do_simples": spec.ex_simples,
    }
    for column, wanted in flags.items():
        if wanted is not None:
            yield F.col(column) == wanted


def matching(leads: DataFrame, spec: SearchSpec) -> DataFrame:
    """All leads the search finds, in no order."""
    return leads.where(reduce(and_, _conditions(spec)))


def page(leads: DataFrame, spec: SearchSpec) -> DataFrame:
    """One page of the search, in its order."""
    return slice_of_order(
        matching(leads, spec), ORDERINGS[spec.ordenar], spec.offset, spec.por_pagina
    )


def stored_page(stored: DataFrame, parts: DataFrame, spec: SearchSpec) -> DataFrame:
    """One page of all leads in the order they are stored in, however deep: a range read."""
    if not spec.unfiltered or spec.ordenar != STORED_ORDER:
        raise ValueError("only pages of all leads in their stored order can be read so")
    return slice_of_stored_order(stored, parts, spec.offset, spec.por_pagina)


def page_count(leads: DataFrame, spec: SearchSpec) -> DataFrame:
    """One row: rows found, pages (at least 1), first and last row of the page."""
    total = F.col("total")
    pages = F.greatest(F.lit(1).cast("long"), F.ceil(total / spec.por_pagina))
    none = F.lit(0).cast("long")
    return (
        matching(leads, spec)
        .agg(F.count("*").alias("total"))
        .select(
            "total",
            pages.alias("paginas"),
            F.when(total > 0, F.lit(spec.offset + 1).cast("long")).otherwise(none).alias("inicio"),
            F.least(F.lit(spec.pagina * spec.por_pagina).cast("long"), total).alias("fim"),
        )
    )
