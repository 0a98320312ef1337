"""Brazilian number text to exact decimals or doubles, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Room for any amount on file, every decimal kept: sums are exact whatever their order.
MONEY = "decimal(38,6)"

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Intl-style amounts keep a no-break space between the sign and the number.
_CURRENCY = "R$\u00a0"


def parse_plain(text: Column) -> Column:
    """Number text with a decimal dot to money; anything else is NULL.

    A decimal cast takes exactly that: signs and exponents, but no "1d" or "NaN",
    which a cast to double would let through. Beyond six decimals it rounds.
    """
    return text.try_cast(MONEY)


def parse_float(text: Column) -> Column:
    """Number text with a decimal dot to double, every digit counted; else NULL.

    The shape is checked first: a cast alone would take "1d" and "NaN".
    """
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_decimal_comma(text: Column) -> Column:
    """``5000000,00`` to double. No thousands marks expected."""
    return parse_float(F.replace(text, F.lit(","), F.lit(".")))


def parse_money_br(text: Column) -> Column:
    """``1.234.567,89`` to money; dots are thousands marks."""
    bare = F.replace(text, F.lit("."), F.lit(""))
    return parse_plain(F.replace(bare, F.lit(","), F.lit(".")))


def format_money_br(amount: Column) -> Column:
    """Amount to ``1.234.567,89``."""
    return F.translate(F.format_number(amount, 2), ",.", ".,")


def format_reais(amount: Column) -> Column:
    """Amount to ``R$ 1.234.567,89``."""
    return F.concat(F.lit("R$ "), format_money_br(amount))


def format_thousands(number: Column) -> Column:
    """Whole number to ``1.234.567``."""
    return F.replace(F.format_number(number, 0), F.lit(","), F.lit("."))


def format_reais_rounded(amount: Column) -> Column:
    """Amount to whole reais, half away from zero, as dashboards print it."""
    return F.concat(F.lit(_CURRENCY), format_thousands(F.round(amount.cast(MONEY), 0)))
