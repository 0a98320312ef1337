"""Records of CSV files that may hold line breaks inside quotes, from files read in splits.

A line either leaves a quoted field open or not, depending on whether it starts inside one.
Both cases are worked out line by line; a line then keeps the state, sets it or turns it.
Such steps combine in any grouping, so each split is worked out by itself and the splits of a
file, a few rows, pass the state on. Only lines of records with breaks are brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from garimpo import fixed_values as fv

#: Characters beyond which lines are no record: one quote left open must not swallow a file.
MAX_RECORD = 1_000_000

# A quoted field as it stands at the start of a line or after a delimiter.
QUOTED_FIELD = r'(^|;)"[^"]*+(?:""[^"]*+)*+"'
_OPEN_FIELD = r'(^|;)"'


class SourceMissing(FileNotFoundError):
    """No file of a required source was found."""


def raw_lines(
    spark: SparkSession, paths: str | Sequence[str], glob: str | None = None
) -> DataFrame:
    """Lines, blank ones too: ``linha``, ``arquivo``, and where they stand in it (``bloco``,
    the start of the split, and ``ordem`` within)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    try:
        lines = reader.text(paths)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise SourceMissing(f"no files under {', '.join(paths)}") from error
        raise
    line = F.decode(F.col("value").cast("binary"), fv.CSV_ENCODING)
    return lines.select(
        line.alias("linha"),
        F.col("_metadata.file_path").alias("arquivo"),
        F.col("_metadata.file_block_start").alias("bloco"),
        F.monotonically_increasing_id().alias("ordem"),
    )


def leaves_open(line: Column) -> Column:
    """Does a line that starts outside quotes end inside a quoted field?"""
    rest = F.regexp_replace(line, QUOTED_FIELD, "$1")
    return F.contains(line, F.lit(fv.CSV_QUOTE)) & rest.rlike(_OPEN_FIELD)


def files_with_breaks(
    spark: SparkSession, paths: str | Sequence[str], glob: str | None = None
) -> list[str]:
    """Files with a line that leaves a quote open; one job over all lines."""
    found = raw_lines(spark, paths, glob).where(leaves_open(F.col("linha")))
    return sorted(row.arquivo for row in found.select("arquivo").distinct().collect())


def _entered(rows: DataFrame, by: Sequence[str], order: str, first: Column | bool) -> Column:
    """Whether each row is entered inside quotes, from ``_set`` and ``_turn`` of those before.

    ``_turns`` must hold the turns before the row. ``first`` is the state at the start.
    """
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(
        F.when(F.col("_set").isNotNull(), F.struct("_set", "_turns")), ignorenulls=True
    ).over(before)
    state = F.coalesce(known["_set"], first if isinstance(first, Column) else F.lit(first))
    turned = (F.col("_turns") - F.coalesce(known["_turns"], F.lit(0))) % 2 == 1
    return state != turned


def _with_turns(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turns = F.sum(F.col("_turn").cast("int")).over(before)
    return rows.withColumn("_turns", F.coalesce(turns, F.lit(0)))


def records(lines: DataFrame) -> DataFrame:
    """``arquivo``, ``linha`` with the lines of a record joined, and ``inteira``.

    Blank lines stay inside records only. False in ``inteira`` marks single lines that are part of no record: a quote that is never closed,
    or only after :data:`MAX_RECORD` characters.
    """
    split = ["arquivo", "bloco"]
    outside = leaves_open(F.col("linha"))
    inside = leaves_open(F.concat(F.lit(fv.CSV_QUOTE), "linha"))
    steps = lines.withColumns({"_outside": outside, "_inside": inside}).withColumns(
        {
            "_set": F.when(F.col("_outside") == F.col("_inside"), F.col("_outside")),
            "_turn": F.col("_outside") & ~F.col("_inside"),
        }
    )
    steps = _with_turns(steps, split, "ordem")

    # What each split does to the state, and the state that it is entered with.
    splits = steps.groupBy(*split).agg(
        F.max_by(F.struct("_set", "_turns"), F.when(F.col("_set").isNotNull(), F.col("ordem")))
        .alias("_last"),
        F.sum(F.col("_turn").cast("int")).alias("_all"),
    )
    turned = (F.col("_all") - F.coalesce("_last._turns", F.lit(0))) % 2 == 1
    splits = splits.select(
        *split,
        F.when(F.col("_last").isNotNull(), F.col("_last._set") != turned).alias("_set"),
        (F.col("_last").isNull() & turned).alias("_turn"),
    )
    splits = _with_turns(splits, ["arquivo"], "bloco")
    entries = splits.select(*split, _entered(splits, ["arquivo"], "bloco", False).alias("_entry"))
    known = steps.join(entries, split)
    known = known.withColumn("_before", _entered(known, split, "ordem", F.col("_entry")))
    known = known.withColumn(
        "_after", F.when(F.col("_before"), F.col("_inside")).otherwise(F.col("_outside"))
    )
    plain = known.where(~F.col("_before") & ~F.col("_after") & (F.trim("linha") != ""))

    # Lines with breaks, each with the line that its record starts with: in its own split,
    # or the last such line of an earlier one.
    broken = known.where(F.col("_before") | F.col("_after"))
    place = F.struct("bloco", "ordem")
    start = F.when(~F.col("_before"), place)
    upto = Window.partitionBy(*split).orderBy("ordem")
    earlier = (
        Window.partitionBy("arquivo").orderBy("bloco").rowsBetween(Window.unboundedPreceding, -1)
    )
    last_starts = broken.groupBy(*split).agg(F.max(start).alias("_start"))
    carried = last_starts.select(
        *split, F.last("_start", ignorenulls=True).over(earlier).alias("_carried")
    )
    broken = broken.withColumn("_start", F.last(start, ignorenulls=True).over(upto)).join(
        carried, split
    )
    broken = broken.withColumn("_start", F.coalesce("_start", "_carried"))
    group = ["arquivo", "_start"]
    sizes = broken.groupBy(*group).agg(
        F.sum(F.length("linha") + 1).alias("_size"), F.max_by("_after", place).alias("_open")
    )
    broken = broken.join(
        sizes.select(*group, ((F.col("_size") <= MAX_RECORD) & ~F.col("_open")).alias("_whole")),
        group,
    )
    joined = (
        broken.where("_whole")
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("bloco", "ordem", "linha"))).alias("_lines"))
        .select("arquivo", F.array_join(F.col("_lines.linha"), "\n").alias("linha"))
    )
    return (
        plain.select("arquivo", "linha", F.lit(True).alias("inteira"))
        .unionAll(joined.select("arquivo", "linha", F.lit(True)))
        .unionAll(broken.where(~F.col("_whole")).select("arquivo", "linha", F.lit(False)))
    )
