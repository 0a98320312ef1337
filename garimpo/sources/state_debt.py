"""State tax debt: seven cells per row, kept for the last days before a given date.

Raw cells arrive as text, ids included: an id stored as a number would have lost
its leading zeros and is dropped for not having 14 digits.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo import fixed_values as fv
from garimpo.functions.dates import serial_to_iso, window_start_serial
from garimpo.functions.identity import company_key, digits, is_company_id
from garimpo.functions.money import MONEY, parse_float, parse_plain
from garimpo.sources.optional import empty_table
from garimpo.sources.registry import odd_width, read_with_raw_line

SCHEMA = (
    "cpf_cnpj string, cnpj_basico string, nome_devedor string, numero_cda string, "
    f"data_inscricao string, especie string, saldo_cda {MONEY}, saldo_nucleo {MONEY}"
)


def read_cells(spark: SparkSession, paths: str | Sequence[str], header: bool = True) -> DataFrame:
    """Rows with at least seven cells; cells beyond the seventh are ignored."""
    width = odd_width(fv.STATE_DEBT_CELLS[0])
    short = (width > 0) & (width < len(fv.STATE_DEBT_CELLS))
    rows = read_with_raw_line(spark, fv.STATE_DEBT_CELLS, paths, header=header)
    return rows.where(~short).select(*fv.STATE_DEBT_CELLS)


def clean(
    cells: DataFrame, as_of: dt.date | Column, days: int, carry: Sequence[str] = ()
) -> DataFrame:
    """Debts of companies registered in the last ``days`` days before ``as_of``.

    The first day counts and later dates stay. The cut compares the serial with its
    time part, the resulting date leaves it off. Rows without a numeric serial are
    dropped, a balance that is no number is NULL. Columns of ``carry`` are handed on; rows
    that one of them marks ``_recusada`` stay.
    """
    id_digits = digits(F.col("cpf_cnpj"))
    serial = parse_float(F.col("data_serial"))
    wanted = (serial >= window_start_serial(as_of, days)) & is_company_id(id_digits)
    if "_recusada" in carry:
        wanted = wanted | F.col("_recusada")
    return cells.where(wanted).select(
        id_digits.alias("cpf_cnpj"),
        company_key(id_digits).alias("cnpj_basico"),
        "nome_devedor",
        "numero_cda",
        serial_to_iso(serial).alias("data_inscricao"),
        "especie",
        parse_plain(F.col("saldo_cda")).alias("saldo_cda"),
        parse_plain(F.col("saldo_nucleo")).alias("saldo_nucleo"),
        *carry,
    )


def empty(spark: SparkSession) -> DataFrame:
    """Stand-in for a source that was not loaded."""
    return empty_table(spark, SCHEMA)
