"""What was loaded, and whether keys are unique."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DuplicateKeys(RuntimeError):
    """A table that must have one row per key has more."""


def load_audit(loads: Mapping[str, tuple[DataFrame, str | Column]]) -> DataFrame:
    """Rows per table and part: ``{table: (rows, part column)}``."""
    counts = [
        rows.groupBy((F.col(part) if isinstance(part, str) else part).alias("parte"))
        .agg(F.count("*").alias("linhas"))
        .select(F.lit(table).alias("tabela"), "parte", "linhas")
        for table, (rows, part) in loads.items()
    ]
    return reduce(DataFrame.unionAll, counts)


def duplicate_keys(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Keys with more than one row, from ``{table: (rows, key)}``: (tabela, chave, linhas)."""
    found = [
        rows.groupBy(F.col(key).alias("chave"))
        .agg(F.count("*").alias("linhas"))
        .where(F.col("linhas") > 1)
        .select(F.lit(table).alias("tabela"), "chave", "linhas")
        for table, (rows, key) in tables.items()
    ]
    return reduce(DataFrame.unionAll, found)


def require_unique(tables: Mapping[str, tuple[DataFrame, str]]) -> None:
    """Raise :class:`DuplicateKeys` if a table repeats a key: joins would multiply rows."""
    worst = duplicate_keys(tables).orderBy(F.desc("linhas")).limit(5).collect()
    if worst:
        examples = ", ".join(f"{r.tabela} {r.chave} ({r.linhas} rows)" for r in worst)
        raise DuplicateKeys(examples)
