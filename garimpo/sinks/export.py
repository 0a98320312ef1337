"""The lead sheet: twenty titled columns in the order sales people read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo import fixed_values as fv
from garimpo.operators.ordering import SortKey, slice_of_order, sort_columns, with_position

# Two decimals as shown, and room for any capital on file.
_AMOUNT = "decimal(38,2)"

SHEET_ORDER: tuple[SortKey, ...] = (
    ("score", "desc"),
    ("dau_valor_total", "desc"),
    ("razao_social", "asc"),
    ("cnpj", "asc"),
)


#: Rows of one file of a written sheet.
ROWS_PER_FILE = 100_000


def default_target(folder: str, uf: str | None) -> str:
    return f"{folder.rstrip('/')}/leads_{(uf or 'br').lower()}"


def lead_sheet(leads: DataFrame, limit: int | None = None, min_findings: int = 0) -> DataFrame:
    """Leads with at least ``min_findings`` findings; no limit when 0 or None."""
    wanted = leads.where(F.col("qtd_apontamentos") >= min_findings)
    if limit:
        ordered = slice_of_order(wanted, SHEET_ORDER, 0, limit)
    else:
        ordered = wanted.orderBy(*sort_columns(SHEET_ORDER))
    return ordered.select(*[F.col(name).alias(title) for name, title in fv.EXPORT_COLUMNS])


def _plain_amounts(sheet: DataFrame) -> DataFrame:
    """Amounts as ``12000000.00``: text files would show large doubles as ``1.2E7``."""
    return sheet.select(
        *[
            F.col(f"`{name}`").cast(_AMOUNT).alias(name) if kind == "double" else F.col(f"`{name}`")
            for name, kind in sheet.dtypes
        ]
    )


def write_sheet(
    leads: DataFrame,
    target: str,
    limit: int | None = None,
    min_findings: int = 0,
    file_format: str = "csv",
    rows_per_file: int = ROWS_PER_FILE,
) -> str:
    """Write the sheet and return its path.

    Files hold ``rows_per_file`` rows each, the last one what is left; their names sort in
    sheet order, and rows stand in order within.
    """
    wanted = leads.where(F.col("qtd_apontamentos") >= min_findings)
    placed = with_position(wanted, SHEET_ORDER)
    if limit:
        placed = placed.where(F.col("posicao") <= limit)
    last = placed.agg(F.max("posicao")).first()[0] or 1
    files = -(-last // rows_per_file)
    file = ((F.col("posicao") - 1) / rows_per_file).cast("int")
    sheet = placed.repartitionById(files, file).sortWithinPartitions("posicao")
    sheet = sheet.select(*[F.col(name).alias(title) for name, title in fv.EXPORT_COLUMNS])
    if file_format == "csv":
        _plain_amounts(sheet).write.mode("overwrite").options(
            header="true",
            sep=fv.CSV_DELIMITER,
            escape=fv.CSV_QUOTE,
            ignoreLeadingWhiteSpace="false",
            ignoreTrailingWhiteSpace="false",
        ).csv(target)
    else:
        sheet.write.mode("overwrite").format(file_format).save(target)
    return target
