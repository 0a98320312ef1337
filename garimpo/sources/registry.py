"""Company registry files: positional CSV, in slices, guarded against layout drift."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from garimpo import fixed_values as fv
from garimpo.sources.files import head
from garimpo.sources.records import (
    QUOTED_FIELD,
    SourceMissing,
    files_with_breaks,
    raw_lines,
    records,
)

_RAW_LINE = "_raw_line"

CSV_OPTIONS = {
    "sep": fv.CSV_DELIMITER,
    "quote": fv.CSV_QUOTE,
    "escape": fv.CSV_QUOTE,
    "encoding": fv.CSV_ENCODING,
    "mode": "PERMISSIVE",
}


class LayoutMismatch(RuntimeError):
    """A file does not have the declared number of columns."""


def suffix_glob(suffix: str) -> str:
    """Glob for a file-name ending in upper, lower or mixed case."""
    return "*" + "".join(
        f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix
    )


def suffix_globs(*suffixes: str) -> str:
    """One glob for several suffixes, in any case."""
    return "{" + ",".join(suffix_glob(f".{suffix}") for suffix in suffixes) + "}"


def string_schema(columns: Iterable[str]) -> T.StructType:
    """All columns as strings: codes keep their leading zeros."""
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def line_width(line: Column) -> Column:
    """Number of fields of a raw CSV line; delimiters inside quotes do not count."""
    without_quoted = F.regexp_replace(line, QUOTED_FIELD, "$1")
    return F.length(F.regexp_replace(without_quoted, f"[^{fv.CSV_DELIMITER}]", "")) + 1


def read_with_raw_line(
    spark: SparkSession,
    columns: Sequence[str],
    paths: str | Sequence[str],
    glob: str | None = None,
    header: bool = False,
) -> DataFrame:
    """CSV rows as strings; a line that is not as wide as declared keeps its raw text.

    Such a line still gives a row, cut or filled with NULL to the declared width.
    """
    # Column pruning inside the CSV parser would hide the true width of a line.
    options = dict(
        CSV_OPTIONS,
        header=str(header).lower(),
        columnNameOfCorruptRecord=_RAW_LINE,
        columnPruning="false",
    )
    if glob:
        options |= {"pathGlobFilter": glob, "recursiveFileLookup": "true"}
    schema = string_schema([*columns, _RAW_LINE])
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        return spark.read.schema(schema).options(**options).csv(paths)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise SourceMissing(f"no files under {', '.join(paths)}") from error
        raise


def odd_width(a_column: str) -> Column:
    """Width of a line that is not as wide as declared, 0 for a regular line.

    Spark refuses queries that read nothing but the raw line, as a count of rows would.
    The second term, always 0, has the query read ``a_column`` too.
    """
    return F.coalesce(
        line_width(F.col(_RAW_LINE)), F.least(F.length(a_column), F.lit(0)), F.lit(0)
    )


def _refused(columns: Sequence[str]) -> Column:
    """Is a line too wide, or of an odd width with quotes that do not balance?"""
    line = F.col(_RAW_LINE)
    quotes = F.length(line) - F.length(F.replace(line, F.lit(fv.CSV_QUOTE), F.lit("")))
    unbalanced = F.coalesce(quotes % 2 == 1, F.lit(False))
    return (odd_width(columns[0]) > len(columns)) | unbalanced


def parse_lines(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``lines`` with ``_campos``, the declared fields of ``linha`` as strings, and
    ``_largura``, its number of fields where that is not as declared."""
    schema = string_schema([*columns, _RAW_LINE]).toDDL()
    options = dict(CSV_OPTIONS, columnNameOfCorruptRecord=_RAW_LINE)
    del options["encoding"]  # the line is text already
    fields = F.from_csv(F.col("linha"), F.lit(schema), options)
    return lines.withColumn("_campos", fields).withColumn(
        "_largura", line_width(F.col(f"_campos.{_RAW_LINE}"))
    )


def _whole_records(
    spark: SparkSession, columns: Sequence[str], files: Sequence[str], header: bool
) -> DataFrame:
    """Records of files with line breaks inside quotes: columns, ``arquivo``, ``linha``,
    ``_largura`` and whether they are refused."""
    lines = records(raw_lines(spark, files))
    if header:
        lines = lines.where(~F.col("linha").isin(*header_lines(spark, files)))
    rows = parse_lines(lines, columns)
    refused = ~F.col("inteira") | (F.coalesce("_largura", F.lit(0)) > len(columns))
    return rows.select(
        *[F.col(f"_campos.`{name}`").alias(name) for name in columns],
        "arquivo", "linha", "_largura", refused.alias("_recusada"),
    )


#: Bytes in which the header line of a file must end.
HEADER_BYTES = 1 << 16


def header_lines(spark: SparkSession, files: Sequence[str]) -> list[str]:
    """The different first lines of files; looked up while planning, without a job."""
    return sorted({line for path in files if (line := header_line(spark, path))})


def header_line(spark: SparkSession, path: str) -> str:
    """The first line of a file, blank ones left out."""
    lines = head(spark, path, HEADER_BYTES).decode(fv.CSV_ENCODING).splitlines()
    return next((line for line in lines if line.strip()), "")


def read_positional_csv(
    spark: SparkSession,
    columns: Sequence[str],
    paths: str | Sequence[str],
    uf: str | None = None,
    glob: str | None = None,
    header: bool = False,
) -> DataFrame:
    """CSV with declared columns, all strings; a header line is skipped if there is one.

    A record with line breaks inside quotes is one row: files that have such records (looked
    up in a job of its own) are read line by line and put together, the others as they are.
    Short records are filled with NULL; those that are too wide, or whose quotes do not
    balance, are left out (see :func:`rejected_lines`). ``uf`` keeps one state while
    scanning, for layouts that have that column.
    """
    plain, broken = _by_breaks(spark, paths, glob)
    rows = None
    if plain:
        rows = read_with_raw_line(spark, columns, plain, glob, header).where(~_refused(columns))
        rows = rows.select(*columns)
    if broken:
        whole = _whole_records(spark, columns, broken, header).where("NOT _recusada")
        whole = whole.select(*columns)
        rows = whole if rows is None else rows.unionAll(whole)
    if uf is not None and "uf" in columns:
        rows = rows.where(F.col("uf") == uf)
    return rows


def _by_breaks(
    spark: SparkSession, paths: str | Sequence[str], glob: str | None
) -> tuple[str | list[str], list[str]]:
    """Files without and with records that hold line breaks; all paths, if none has."""
    broken = files_with_breaks(spark, paths, glob)
    if not broken:
        return paths, []
    every = {
        path
        for one in ([paths] if isinstance(paths, str) else paths)
        for path in list_files(spark, one, glob or "*")
    }
    return sorted(every - set(broken)), broken


def rejected_lines(
    spark: SparkSession,
    columns: Sequence[str],
    paths: str | Sequence[str],
    glob: str | None = None,
    header: bool = False,
) -> DataFrame:
    """Lines left out by :func:`read_positional_csv`: file, width and raw text."""
    plain, broken = _by_breaks(spark, paths, glob)
    out = None
    if plain:
        out = (
            read_with_raw_line(spark, columns, plain, glob, header)
            .withColumn("arquivo", F.input_file_name())
            .where(_refused(columns))
            .select(
                "arquivo",
                line_width(F.col(_RAW_LINE)).alias("largura"),
                F.col(_RAW_LINE).alias("linha"),
            )
        )
    if broken:
        more = _whole_records(spark, columns, broken, header).where("_recusada")
        more = more.select("arquivo", line_width(F.col("linha")).alias("largura"), "linha")
        out = more if out is None else out.unionAll(more)
    return out


def slice_paths(root: str, folder: str, slices: Iterable[int] | None = None) -> str:
    """One glob over all numbered slice folders, or over the wanted ones that are there."""
    if slices is None:
        return f"{root.rstrip('/')}/{folder}[0-9]*"
    return f"{root.rstrip('/')}/{folder}{{{','.join(str(i) for i in slices)}}}"


def read_table(
    spark: SparkSession,
    root: str,
    table: str,
    slices: int | None = None,
    uf: str | None = None,
    suffix: str | None = None,
) -> DataFrame:
    """One registry table from the landing zone ``root``.

    ``empresas``, ``estabelecimentos`` and ``socios`` come in numbered folders, of
    which all, or the first ``slices``, are read as one scan; the others have one folder.
    """
    folder = fv.REGISTRY_FOLDERS[table]
    if table in fv.SLICED_TABLES:
        path = slice_paths(root, folder, None if slices is None else range(slices))
    else:
        path = f"{root.rstrip('/')}/{folder}"
    return read_positional_csv(
        spark,
        fv.REGISTRY_LAYOUTS[table],
        path,
        uf=uf,
        glob=suffix_glob(suffix or fv.REGISTRY_SUFFIXES[table]),
    )


def list_files(spark: SparkSession, path: str, glob: str = "*") -> list[str]:
    """File paths below ``path``. Lists names only; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        found = reader.option("pathGlobFilter", glob).load(path).select("path")
        return sorted(row.path for row in found.collect())
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def layout_profile(
    spark: SparkSession, paths: str | Sequence[str], glob: str = "*"
) -> DataFrame:
    """Lines per file and width over whole files: (arquivo, largura, linhas)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(paths)
        .where(F.length("value") > 0)
        .select(F.input_file_name().alias("arquivo"), line_width(F.col("value")).alias("largura"))
        .groupBy("arquivo", "largura")
        .agg(F.count("*").alias("linhas"))
    )


def check_layout(spark: SparkSession, columns: Sequence[str], files: Sequence[str]) -> None:
    """Raise :class:`LayoutMismatch` unless most lines of each file have the declared width.

    Looks at every line of every file, in one job; an empty file passes. Single odd lines
    are no mismatch: they are what :func:`rejected_lines` lists.
    """
    if not files:
        return
    usual = (
        layout_profile(spark, files)
        .groupBy("arquivo")
        .agg(
            F.max_by("largura", F.struct("linhas", "largura")).alias("usual"),
            F.sort_array(F.collect_set("largura")).alias("larguras"),
        )
        .where(F.col("usual") != len(columns))
        .orderBy("arquivo")
    )
    worst = usual.first()
    if worst:
        raise LayoutMismatch(
            f"{worst.arquivo}: {len(columns)} columns declared, "
            f"lines have {list(worst.larguras)}, most of them {worst.usual}"
        )
