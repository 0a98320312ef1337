"""Loading CSV files into a stage table: each file is read once.

Rows and rejected lines leave one scan by one write, told apart by a partition. The widths
of all lines are counted per file by the same job, so drift of a layout is seen before the
table becomes current. Files with a record that holds a line break inside quotes show in the
rejected lines; only those are read again, line by line, to put such records together.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo import fixed_values as fv
from garimpo.sinks import versions
from garimpo.sinks.stages import keyed_writer, partitioned_writer
from garimpo.sinks.versions import Version
from garimpo.sources import files
from garimpo.sources.records import leaves_open, raw_lines, records
from garimpo.sources.registry import LayoutMismatch, header_lines, parse_lines

#: Columns that a source's rows carry on their way into the table.
CARRIED = ("_recusada", "_aberta", "_arquivo", "_largura", "_linha")
REJECTED = "_arquivo AS arquivo", "_largura AS largura", "_linha AS linha"
_REJECTED_SCHEMA = "_arquivo string, _largura int, _linha string, _destino string"

#: From parsed columns and CARRIED ones to the table's columns and CARRIED ones. Lines with
#: ``_recusada`` must pass every filter.
Shape = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Source:
    """Files of one layout. ``wide`` and ``short`` say whether longer and shorter lines than
    declared are taken, cut or filled with NULL."""

    part: str
    files: Sequence[str]
    columns: Sequence[str]
    shape: Shape
    header: bool = False
    short: bool = True
    wide: bool = False


@dataclass(frozen=True)
class Lines:
    """Lines of a file that are as wide as declared, and others."""

    source: Source
    file: str
    usual: int
    odd: int


@dataclass
class Load:
    """A table that was written but is not current yet."""

    versions: dict[str, Version]
    #: part, file, lines read, rows loaded, lines rejected
    audit: list[tuple[str, str, int, int, int]] = field(default_factory=list)

    @property
    def loaded(self) -> int:
        return sum(row[3] for row in self.audit)

    @property
    def rejected(self) -> int:
        return sum(row[4] for row in self.audit)


def _parsed(lines: DataFrame, source: Source, open_quotes: Column) -> DataFrame:
    """Declared columns and CARRIED ones of lines."""
    rows = parse_lines(lines, source.columns)
    declared = len(source.columns)
    width = F.coalesce("_largura", F.lit(declared))
    quotes = F.length("linha") - F.length(F.replace("linha", F.lit(fv.CSV_QUOTE), F.lit("")))
    refused = open_quotes | ((width != declared) & (quotes % 2 == 1))
    if not source.wide:
        refused = refused | (width > declared)
    if not source.short:
        refused = refused | (width < declared)
    return rows.select(
        *[F.col(f"_campos.`{name}`").alias(name) for name in source.columns],
        refused.alias("_recusada"),
        open_quotes.alias("_aberta"),
        F.col("arquivo").alias("_arquivo"),
        width.cast("int").alias("_largura"),
        F.when(refused, F.col("linha")).alias("_linha"),
    )


def _lines(spark: SparkSession, source: Source) -> DataFrame:
    return _without_header(
        spark, raw_lines(spark, source.files).where(F.trim("linha") != ""), source, source.files
    )


def _without_header(
    spark: SparkSession, lines: DataFrame, source: Source, paths: Sequence[str]
) -> DataFrame:
    if not source.header:
        return lines
    return lines.where(~F.col("linha").isin(*header_lines(spark, paths)))


def _file_mark(uri: str) -> float:
    return float(zlib.crc32(uri.encode()))


def _counted(rows: DataFrame, source: Source, name: str) -> tuple[DataFrame, Observation]:
    """``rows``, counted per file while they pass: lines of the declared width, and others.

    A histogram with room for every file is exact; files are told apart by a checksum.
    """
    seen = Observation(name)
    mark = F.crc32(F.col("_arquivo").cast("binary")).cast("double")
    usual = F.col("_largura") == len(source.columns)
    room = F.lit(4 * len(source.files) + 16)
    counted = rows.observe(
        seen,
        F.histogram_numeric(F.when(usual, mark), room).alias("usual"),
        F.histogram_numeric(F.when(~usual, mark), room).alias("odd"),
    )
    return counted, seen


def _lines_per_file(spark: SparkSession, source: Source, seen: Observation) -> list[Lines]:
    counted = seen.get

    def total(kind: str, mark: float) -> int:
        return sum(int(b.y) for b in counted[kind] or () if b.x == mark)

    uris = [files.qualified(spark, path) for path in source.files]
    return [
        Lines(source, uri, total("usual", _file_mark(uri)), total("odd", _file_mark(uri)))
        for uri in uris
    ]


def _destination(rows: DataFrame) -> DataFrame:
    out = rows.withColumn(
        "_destino", F.when(F.col("_recusada"), "recusadas").otherwise("linhas")
    )
    return out.withColumn("_largura", F.when(F.col("_recusada"), F.col("_largura")))


def _whole(spark: SparkSession, source: Source, paths: Sequence[str]) -> DataFrame:
    """The rows of files whose records hold line breaks."""
    lines = _without_header(spark, records(raw_lines(spark, paths)), source, paths)
    return _destination(source.shape(_parsed(lines, source, ~F.col("inteira"))))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def load(
    spark: SparkSession,
    stage: str,
    table: str,
    sources: Sequence[Source],
    partition_by: Sequence[str] = (),
    key: str | None = None,
) -> Load:
    """Write a table and ``<table>_recusadas`` from its sources; commit both yourself.

    Raises :class:`LayoutMismatch` if most lines of a file are not as wide as declared.
    With ``key`` the rows are stored in its order, for lookups.
    """
    seen, parts = [], []
    for number, source in enumerate(sources):
        parsed = _parsed(_lines(spark, source), source, leaves_open(F.col("linha")))
        counted, observation = _counted(parsed, source, f"{table}-{number}")
        seen.append((source, observation))
        parts.append(_destination(source.shape(counted)))
    written = _union(parts)
    staged = _Staged(spark, stage, table, partition_by, written.schema)
    staged.write(written)

    lines = [one for source, found in seen for one in _lines_per_file(spark, source, found)]
    rows, broken = staged.by_file()
    for one in lines:
        strict = not (one.source.wide and one.source.short)
        if strict and one.odd > one.usual and one.file not in broken:
            files.delete_folder(spark, f"{stage}/{staged.folder}")
            raise LayoutMismatch(
                f"{one.file}: {len(one.source.columns)} columns declared, "
                f"{one.odd} of {one.usual + one.odd} lines have another width"
            )
    if broken:
        parts = [staged.read().where(~F.col("_arquivo").isin(*sorted(broken)))]
        for source in sources:
            own = sorted(broken & {files.qualified(spark, path) for path in source.files})
            if own:
                parts.append(_whole(spark, source, own).select(*parts[0].columns))
        staged.write(_union(parts))
        rows, _ = staged.by_file()

    audit = [
        (one.source.part, one.file, one.usual + one.odd, rows.get((one.file, "linhas"), 0),
         rows.get((one.file, "recusadas"), 0))
        for one in lines
    ]
    any_rows = any(kind == "linhas" for _, kind in rows)
    return Load(
        {
            table: staged.rows_version(any_rows, key),
            f"{table}_recusadas": staged.rejected_version(),
        },
        audit,
    )


class _Staged:
    """Rows and rejected lines as written by one pass, in a partition each."""

    def __init__(self, spark, stage: str, table: str, partition_by, schema: T.StructType):
        self.spark, self.stage, self.table = spark, stage, table
        self.partition_by, self.schema = partition_by, schema
        self.folder = ""

    def write(self, rows: DataFrame) -> None:
        self.folder = versions.new_folder(self.table)
        writer = partitioned_writer(rows, "append", self.partition_by, ["_destino"])
        writer.parquet(f"{self.stage}/{self.folder}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.stage}/{self.folder}")

    def by_file(self) -> tuple[dict[tuple[str, str], int], set[str]]:
        """Rows per file and partition, and files with a line that leaves a quote open."""
        found = self.read().groupBy("_arquivo", "_destino").agg(
            F.count("*").alias("n"), F.max("_aberta").alias("aberta")
        ).collect()
        counts = {(row._arquivo, row._destino): row.n for row in found}
        return counts, {row._arquivo for row in found if row.aberta}

    def rows_version(self, any_rows: bool, key: str | None) -> Version:
        """Where the rows lie: as written, or once more in the order of a key."""
        left_out = (*CARRIED, "_destino")
        own = T.StructType([f for f in self.schema if f.name not in left_out])
        if any_rows and key is None:
            return Version(f"{self.folder}/_destino=linhas")
        folder = versions.new_folder(self.table)
        if any_rows:
            rows = self.read().where("_destino = 'linhas'").select(*own.names, "_arquivo")
            keyed_writer(rows, key).parquet(f"{self.stage}/{folder}")
        else:
            empty = self.spark.createDataFrame([], own)
            empty.write.parquet(f"{self.stage}/{folder}")
        return Version(folder)

    def rejected_version(self) -> Version:
        return Version(self.folder, REJECTED, "_destino = 'recusadas'", _REJECTED_SCHEMA)
