"""Dates as the sources write them: compact text, ISO text, spreadsheet serials."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from garimpo import fixed_values as fv

_DAY_ZERO = dt.date.fromisoformat(fv.SERIAL_DAY_ZERO)
_FIRST_SERIAL = (dt.date.min - _DAY_ZERO).days
_LAST_SERIAL = (dt.date.max - _DAY_ZERO).days


def drop_sentinels(text: Column) -> Column:
    """Registry dates write "no date" as ``0`` or ``00000000``; make both NULL."""
    for sentinel in fv.DATE_SENTINELS:
        text = F.nullif(text, F.lit(sentinel))
    return text


def _slashes(text: Column, year: int, month: int, day: int) -> Column:
    return F.concat_ws(
        "/", F.substring(text, day, 2), F.substring(text, month, 2), F.substring(text, year, 4)
    )


def compact_to_br(text: Column) -> Column:
    """``AAAAMMDD`` to ``DD/MM/AAAA``; NULL stays NULL."""
    return F.when(text.isNotNull(), _slashes(text, 1, 5, 7))


def date_br(text: Column) -> Column:
    """Any source date to ``DD/MM/AAAA``: no value gives a dash, other text stays."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (
        F.when(text.isNull() | (text == ""), F.lit(fv.EMPTY_MARK))
        .when(trimmed.rlike(r"^[0-9]{8}$"), _slashes(trimmed, 1, 5, 7))
        .when(trimmed.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), _slashes(trimmed, 1, 6, 9))
        .otherwise(trimmed)
    )


def serial_to_iso(serial: Column) -> Column:
    """Spreadsheet serial (number) to ``AAAA-MM-DD``; the time part is cut off.

    Serials outside the years 1-9999 give NULL.
    """
    day = F.when(
        (serial > _FIRST_SERIAL - 1) & (serial < _LAST_SERIAL + 1), serial.cast("int")
    )
    return F.date_add(F.lit(_DAY_ZERO), day).cast("string")


def window_start_serial(as_of: dt.date | Column, days: int) -> Column:
    """Serial of the first day of the last ``days`` days before ``as_of``."""
    today = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.datediff(F.date_sub(today, days), F.lit(_DAY_ZERO))
