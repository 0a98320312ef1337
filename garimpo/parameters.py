"""Run parameters with their defaults; values reach queries as literals."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


def _whole(value: object) -> int | None:
    return None if value is None else int(value)


@dataclass(frozen=True)
class ScoreWeights:
    """Points each signal adds to the 0-100 score."""

    divida_ativa_uniao: int = 30
    divida_ativa_mg: int = 25
    situacao_irregular: int = 25
    sancao: int = 15
    saiu_do_simples: int = 20
    porte_demais: int = 10


@dataclass(frozen=True)
class Parameters:
    """All settings of a run. ``uf=None`` covers the whole country."""

    uf: str | None = "MG"
    pgfn_ano: int = 2026
    pgfn_trimestre: int = 2
    janela_dias: int = 365
    fatias: int | None = None
    situacoes_cadastrais: tuple[str, ...] = ("02", "03", "04")
    prefixo_natureza_juridica: str = "2"
    somente_matriz: bool = True
    somente_com_apontamento: bool = True
    capital_lucro_real: int = 1_000_000
    weights: ScoreWeights = field(default_factory=ScoreWeights)

    @property
    def federal_debt_folder(self) -> str:
        """Folder of the quarterly federal-debt publication."""
        return f"{self.pgfn_ano}_trimestre_{self.pgfn_trimestre:02d}"

    def replace(self, **changes: Any) -> "Parameters":
        return dataclasses.replace(self, **changes)

    @classmethod
    def from_mapping(cls, settings: Mapping[str, Any]) -> "Parameters":
        """Build from a nested settings mapping, e.g. a parsed YAML or JSON file.

        Missing entries keep their defaults; a state is stored in upper case.
        """
        base = cls()
        universe = settings.get("universo", {})
        weights = settings.get("score", {})
        names = [f.name for f in dataclasses.fields(ScoreWeights)]
        uf = settings.get("uf", base.uf)
        return cls(
            uf=str(uf).upper() if uf else None,
            pgfn_ano=int(settings.get("pgfn", {}).get("ano", base.pgfn_ano)),
            pgfn_trimestre=int(settings.get("pgfn", {}).get("trimestre", base.pgfn_trimestre)),
            janela_dias=int(settings.get("mg_divida", {}).get("janela_dias", base.janela_dias)),
            fatias=_whole(settings.get("receita", {}).get("fatias", base.fatias)),
            situacoes_cadastrais=tuple(
                str(code)
                for code in universe.get("situacoes_cadastrais", base.situacoes_cadastrais)
            ),
            prefixo_natureza_juridica=str(
                universe.get("prefixo_natureza_juridica", base.prefixo_natureza_juridica)
            ),
            somente_matriz=bool(universe.get("somente_matriz", base.somente_matriz)),
            somente_com_apontamento=bool(
                universe.get("somente_com_apontamento", base.somente_com_apontamento)
            ),
            capital_lucro_real=int(
                settings.get("regime", {}).get("capital_lucro_real", base.capital_lucro_real)
            ),
            weights=ScoreWeights(
                **{n: int(weights[f"peso_{n}"]) for n in names if f"peso_{n}" in weights}
            ),
        )
