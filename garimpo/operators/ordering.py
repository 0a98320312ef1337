"""Total orders, exact row positions and slices of an order, without one big task.

``orderBy`` sorts by range, so rows of one hot key spread over many tasks as long as
the full sort key tells them apart; every order here therefore ends in a tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.plans.session import cut_lineage

# Up to this many rows the start of an order is taken by a top-k: each task keeps that
# many rows and one task merges them. Beyond it, exact positions are used instead.
TOP_K_ROWS = 10_000

# (column, "asc" | "desc"); NULL sorts last both ways.
SortKey = tuple[str, str]


def sort_columns(keys: Sequence[SortKey]) -> list[Column]:
    return [
        F.desc_nulls_last(name) if way == "desc" else F.asc_nulls_last(name)
        for name, way in keys
    ]


def with_position(
    rows: DataFrame,
    keys: Sequence[SortKey],
    position: str = "posicao",
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact 1-based position of each row in the order, overall or within ``by``.

    The range sort is written out once; each of its partitions numbers its own rows,
    and the count of rows in earlier partitions is added. That count has one row per
    partition, or per partition and group, never one task per group.
    """
    order = [*[F.asc_nulls_last(name) for name in by], *sort_columns(keys)]
    numbered = cut_lineage(
        rows.orderBy(*order).withColumn("_numero", F.monotonically_increasing_id())
    ).withColumn("_parte", F.shiftright("_numero", 33))

    runs = numbered.groupBy(*by, "_parte").agg(
        F.count("*").alias("_linhas"), F.min("_numero").alias("_primeiro")
    )
    earlier = Window.orderBy("_parte")
    if by:
        earlier = Window.partitionBy(*by).orderBy("_parte")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        *by,
        "_parte",
        (F.coalesce(F.sum("_linhas").over(earlier), F.lit(0)) - F.col("_primeiro") + 1).alias(
            "_desvio"
        ),
    )
    if not by:
        # One row per sort partition.
        starts = F.broadcast(starts)
    return (
        numbered.join(starts, [*by, "_parte"])
        .withColumn(position, F.col("_numero") + F.col("_desvio"))
        .drop("_numero", "_parte", "_desvio")
    )


def slice_of_order(
    rows: DataFrame, keys: Sequence[SortKey], offset: int, limit: int
) -> DataFrame:
    """Rows ``offset+1 .. offset+limit`` of the order, in order."""
    order = sort_columns(keys)
    if offset + limit <= TOP_K_ROWS:
        ordered = rows.orderBy(*order)
        return (ordered.offset(offset) if offset else ordered).limit(limit)
    wanted = F.col("_posicao").between(offset + 1, offset + limit)
    return (
        with_position(rows, keys, "_posicao").where(wanted).orderBy("_posicao").drop("_posicao")
    )


def positions_of_looked_up(
    rows: DataFrame, keys: Sequence[SortKey], by: str, position: str = "posicao"
) -> DataFrame:
    """Exact position of each row within ``by``, planned without running anything.

    For rows of a few groups, of which one may still be very large: a group is cut by the
    leading digits or letters of its first sort key, every cut is numbered by itself, and
    the rows of earlier cuts, counted beside it, are added.
    """
    name, way = keys[0]
    cut = _leading(rows, name)
    marked = rows.withColumns({"_sem": F.col(name).isNull(), "_corte": cut})
    earlier = (
        Window.partitionBy(by)
        .orderBy("_sem", F.desc("_corte") if way == "desc" else F.asc("_corte"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    cuts = marked.groupBy(by, "_sem", "_corte").agg(F.count("*").alias("_linhas"))
    cuts = cuts.select(
        by, "_sem", "_corte", F.coalesce(F.sum("_linhas").over(earlier), F.lit(0)).alias("_antes")
    )
    inside = Window.partitionBy(by, "_sem", "_corte").orderBy(*sort_columns(keys))
    return (
        marked.withColumn("_numero", F.row_number().over(inside))
        .join(cuts, [by, "_sem", "_corte"])
        .withColumn(position, F.col("_numero") + F.col("_antes"))
        .drop("_sem", "_corte", "_numero", "_antes")
    )


def _leading(rows: DataFrame, name: str) -> Column:
    """A coarse form of a column that keeps its order; the least one for NULL."""
    if dict(rows.dtypes)[name] == "string":
        return F.coalesce(F.substring(name, 1, 3), F.lit(""))
    # A sixteenth of a doubling for amounts from 1 up; those below are one cut.
    value = F.greatest(F.col(name).cast("double"), F.lit(1.0))
    return F.coalesce(F.floor(16 * F.log2(value)), F.lit(0))


#: Where a row of a stored order lies: its sort partition in the upper bits.
PLACE = "_lugar"


def parts_of_order(stored: DataFrame) -> DataFrame:
    """Rows of every sort partition of rows stored in order: (parte, linhas)."""
    return stored.groupBy(F.shiftright(PLACE, 33).cast("int").alias("parte")).agg(
        F.count("*").alias("linhas")
    )


def slice_of_stored_order(
    stored: DataFrame, parts: DataFrame, offset: int, limit: int
) -> DataFrame:
    """Rows ``offset+1 .. offset+limit`` of rows stored with :data:`PLACE`.

    ``parts``, one row per sort partition, tells where they lie; only those places are read.
    """
    wanted, before = F.lit(False), 0
    for part in parts.orderBy("parte").collect():
        low = max(offset - before, 0)
        high = min(offset + limit - before, part.linhas)
        if low < high:
            first = part.parte << 33
            wanted = wanted | F.col(PLACE).between(first + low, first + high - 1)
        before += part.linhas
    return stored.where(wanted).orderBy(PLACE).limit(limit).drop(PLACE)
