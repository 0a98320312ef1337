"""CSV files with a header whose column names vary from file to file."""

from __future__ import annotations

import csv
import re
import unicodedata
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo import fixed_values as fv
from garimpo.sources.files import is_folder
from garimpo.sources.registry import (
    check_layout,
    header_line,
    list_files,
    read_positional_csv,
    rejected_lines,
)

Aliases = Mapping[str, Sequence[str]]


def normalise_name(name: str) -> str:
    """``Órgão Sancionador`` to ``orgao_sancionador``: bare letters and digits, in lower case."""
    bare = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", name))
    return "_".join(re.findall(r"[^\W_]+", bare.lower()))


def resolve_names(names: Iterable[str], aliases: Aliases) -> dict[str, str | None]:
    """Real column for each canonical name, or None.

    Every header name that is an alias applies for its canonical column with the alias's
    rank; the lowest rank gets it, and of equal ranks the name that stands last.
    """
    ranks: dict[str, list[tuple[str, int]]] = {}
    for canonical, options in aliases.items():
        for rank, alias in enumerate(options):
            ranks.setdefault(alias, []).append((canonical, rank))
    offers: dict[str, list[tuple[int, int, str]]] = {canonical: [] for canonical in aliases}
    for place, name in enumerate(names):
        for canonical, rank in ranks.get(normalise_name(name), ()):
            offers[canonical].append((rank, -place, name))
    return {canonical: min(found)[2] if found else None for canonical, found in offers.items()}


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Column names in the header line of a file (or of the files of a folder).

    A name that was there before, in whatever case, gets a number, a missing one too. Only
    the head of the file is looked at, while planning; no job is run.
    """
    first = next(iter(list_files(spark, path)), path) if is_folder(spark, path) else path
    fields = next(
        csv.reader([header_line(spark, first)], delimiter=fv.CSV_DELIMITER, quotechar=fv.CSV_QUOTE),
        [],
    )
    names: list[str] = []
    seen: set[str] = set()
    for position, name in enumerate(fields):
        unique = name or f"column{position}"
        if unique.lower() in seen:
            unique = f"{unique}_{position}"
        seen.add(unique.lower())
        names.append(unique)
    return names


def read_header_csv(
    spark: SparkSession, paths: str | Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """Header CSV, every column a string. All ``paths`` must share one header.

    Short lines are filled with NULL, lines that are too wide or whose quotes do not
    balance are left out (see :func:`rejected_canonical`).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    names = names or header_names(spark, paths[0])
    return read_positional_csv(spark, plain_names(names), paths, header=True).toDF(*names)


def plain_names(names: Sequence[str]) -> list[str]:
    return [f"c{position}" for position in range(len(names))]


def to_canonical(
    rows: DataFrame, aliases: Aliases, carry: Sequence[str] = ()
) -> DataFrame | None:
    """Canonical columns of ``rows``; absent ones are NULL. Those of ``carry`` are handed on.

    None when there is no company-id column: such a file is skipped.
    """
    real = resolve_names([name for name in rows.columns if name not in carry], aliases)
    if real["cpf_cnpj"] is None:
        return None

    def pick(canonical: str) -> Column:
        name = real[canonical]
        value = F.col(f"`{name.replace('`', '``')}`") if name else F.lit(None).cast("string")
        return value.alias(canonical)

    return rows.select(*[pick(canonical) for canonical in aliases], *carry)


def by_header(spark: SparkSession, files: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by header. Only the header line of each file is looked at."""
    found: dict[tuple[str, ...], list[str]] = {}
    for path in files:
        if names := tuple(header_names(spark, path)):
            found.setdefault(names, []).append(path)
    return found


def read_canonical(
    spark: SparkSession, files: Sequence[str], aliases: Aliases
) -> DataFrame | None:
    """All files in canonical columns: one scan per distinct header, then a union.

    Only the header line of each file is looked at while planning.
    """
    parts = [
        part
        for names, paths in by_header(spark, files).items()
        if (part := to_canonical(read_header_csv(spark, paths, names), aliases)) is not None
    ]
    return reduce(DataFrame.unionByName, parts) if parts else None


def rejected_canonical(
    spark: SparkSession, files: Sequence[str], aliases: Aliases, check: bool = True
) -> DataFrame:
    """Lines left out by :func:`read_canonical`: file, width and raw text.

    Files that are skipped for want of a company id are skipped here too. With ``check``,
    a file most of whose lines are not as wide as its header raises ``LayoutMismatch``.
    """
    rejected = spark.createDataFrame([], "arquivo string, largura int, linha string")
    for names, paths in by_header(spark, files).items():
        if resolve_names(names, aliases)["cpf_cnpj"] is None:
            continue
        if check:
            check_layout(spark, names, paths)
        rejected = rejected.unionByName(rejected_lines(spark, plain_names(names), paths, header=True))
    return rejected
