"""Company ids, blanks and phone text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from garimpo import fixed_values as fv


def digits(text: Column) -> Column:
    """Only the digits 0-9 of a text."""
    return F.regexp_replace(text, "[^0-9]", "")


def is_company_id(cnpj: Column) -> Column:
    return F.length(cnpj) == fv.CNPJ_LENGTH


def company_key(cnpj: Column) -> Column:
    """First eight digits: the join key of every source."""
    return F.substring(cnpj, 1, 8)


def format_cnpj(cnpj: Column) -> Column:
    """``NN.NNN.NNN/NNNN-NN``."""
    parts = ((1, 2, ""), (3, 3, "."), (6, 3, "."), (9, 4, "/"), (13, 2, "-"))
    pieces = []
    for start, size, mark in parts:
        pieces += [F.lit(mark), F.substring(cnpj, start, size)]
    return F.concat(*pieces)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def phone(area: Column, number: Column) -> Column:
    """``(31) 33001000`` when both parts are filled, else NULL."""
    return F.when(
        (area != "") & (number != ""), F.concat(F.lit("("), area, F.lit(") "), number)
    )
