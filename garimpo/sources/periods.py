"""Which publication of a source to use: newest month, newest recent snapshot."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo import fixed_values as fv
from garimpo.sources.files import names
from garimpo.sources.records import SourceMissing
from garimpo.sources.registry import list_files, suffix_globs

_MONTH_FOLDER = re.compile("(?:competencia=)?([0-9]{4}-[0-9]{2})")
_SNAPSHOT_FILES = suffix_globs("csv", "txt")


def latest_period_folder(spark: SparkSession, root: str) -> str:
    """Folder of the newest ``AAAA-MM`` in ``root`` that holds anything, or ``root`` if flat.

    Names directly below ``root`` are looked at, not the files of every month.
    """
    root = root.rstrip("/")
    found = names(spark, root)
    if not found:
        raise SourceMissing(f"no month folders and no files under {root}")
    months = {
        match.group(1): name for name in found if (match := _MONTH_FOLDER.fullmatch(name))
    }
    for month in sorted(months, reverse=True):
        if names(spark, f"{root}/{months[month]}"):
            return f"{root}/{months[month]}"
    return root


def latest_period(rows: DataFrame, period: str = "competencia") -> DataFrame:
    """Rows of the newest period.

    The newest value is a scalar subquery, so a table partitioned by ``period`` is
    read from the newest partition only.
    """
    newest = rows.agg(F.max(period)).scalar()
    return rows.where(F.col(period) == newest)


def latest_snapshot(
    rows: DataFrame,
    as_of: dt.date | Column,
    register: str = "cadastro",
    snapshot: str = "snapshot_date",
    days: int = fv.SNAPSHOT_DAYS,
) -> DataFrame:
    """Per register, the rows of its newest snapshot in the last ``days`` days.

    A register without a snapshot in that window has no rows.
    """
    today = as_of if isinstance(as_of, Column) else F.lit(as_of)
    recent = rows.where(
        F.col(register).isin(*fv.SANCTION_REGISTERS)
        & F.col(snapshot).between(F.date_sub(today, days - 1), today)
    )
    # At most one row per known register, hence the broadcast.
    newest = recent.groupBy(register).agg(F.max(snapshot).alias(snapshot))
    return recent.join(F.broadcast(newest), [register, snapshot], "left_semi")


def latest_snapshot_files(
    spark: SparkSession, folder: str, as_of: dt.date, days: int = fv.SNAPSHOT_DAYS
) -> dict[str, list[str]]:
    """Newest dated files per register: ``<register>_AAAAMMDD`` anywhere below the folder.

    Only tables count, so an archive beside an older unpacked day does not hide it.
    """
    stamps = [(as_of - dt.timedelta(days=back)).strftime("%Y%m%d") for back in range(days)]
    paths = list_files(spark, folder, _SNAPSHOT_FILES)
    newest = {}
    for register in fv.SANCTION_REGISTERS:
        for stamp in stamps:
            mark = f"{register.lower()}_{stamp}"
            if files := [path for path in paths if mark in path.lower()]:
                newest[register] = files
                break
    return newest
