"""Versions of stage tables: the tables of a run change together, or none does.

A run writes each table to a new folder below the stage and at last one small state file,
which names the folder of every table; the newest state file counts. A run that fails
before that leaves the old tables as they were, and a reader that has looked up a table keeps
reading what it found. A table may also be a selection of columns of another's folder.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from garimpo.sources import files

_STATES = "_estado"
_STATE_NAME = re.compile(r"[0-9]{8}\.json")


@dataclass(frozen=True)
class Version:
    """Where a table lies below the stage, and which of its rows and expressions it has.

    With a ``schema`` the folder may be without any file.
    """

    folder: str
    select: tuple[str, ...] = ()
    where: str = ""
    schema: str = ""


def new_folder(table: str) -> str:
    """An unused folder name for a table, below the stage."""
    return f"{table}/versao-{uuid.uuid4().hex}"


def _states(spark: SparkSession, stage: str) -> list[str]:
    found = files.names(spark, f"{stage}/{_STATES}")
    return [name for name in found if _STATE_NAME.fullmatch(name)]


def current(spark: SparkSession, stage: str) -> dict[str, Version]:
    """The tables of a stage as last committed."""
    states = _states(spark, stage)
    if not states:
        return {}
    text = files.head(spark, f"{stage}/{_STATES}/{states[-1]}", 1 << 24)
    return {
        table: Version(**{**entry, "select": tuple(entry["select"])})
        for table, entry in json.loads(text).items()
    }


def commit(
    spark: SparkSession, stage: str, tables: Mapping[str, Version], gone: Iterable[str] = ()
) -> None:
    """Make these versions the current ones, all at once; other tables stay but ``gone``."""
    gone = set(gone)
    while True:
        states = _states(spark, stage)
        number = int(states[-1].split(".")[0]) + 1 if states else 1
        kept = {name: v for name, v in current(spark, stage).items() if name not in gone}
        text = json.dumps(
            {name: asdict(v) for name, v in sorted({**kept, **tables}.items())}
        )
        # Another run may have been first: then look again, so that neither is lost.
        if files.write_new(spark, f"{stage}/{_STATES}/{number:08d}.json", text):
            return


def read(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """A table of a stage, as committed; a folder that no state names is read as it is."""
    stage, _, table = path.rstrip("/").rpartition("/")
    version = current(spark, stage).get(table)
    reader = spark.read.schema(schema) if schema else spark.read
    if version is None:
        return reader.parquet(path)
    if not version.select:
        return reader.parquet(f"{stage}/{version.folder}")
    reader = spark.read.schema(version.schema) if version.schema else spark.read
    rows = reader.parquet(f"{stage}/{version.folder}")
    return (rows.where(version.where) if version.where else rows).selectExpr(*version.select)


def drop_unused(spark: SparkSession, stage: str) -> list[str]:
    """Delete versions that are no longer current, once nobody reads them any more."""
    used = {version.folder.split("/")[1] for version in current(spark, stage).values()}
    dropped = []
    for table in files.names(spark, stage):
        for name in files.names(spark, f"{stage}/{table}"):
            if name.startswith("versao-") and name not in used:
                files.delete_folder(spark, f"{stage}/{table}/{name}")
                dropped.append(f"{table}/{name}")
    return dropped
