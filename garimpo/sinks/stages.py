"""Stage tables as Parquet: replaced as a whole, or extended by late slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.operators.ordering import SortKey, sort_columns
from garimpo.sinks import versions


def partitioned_writer(
    rows: DataFrame, mode: str, partition_by: Sequence[str], first: Sequence[str] = ()
) -> DataFrameWriter:
    """Writer with the partitions ``first`` (few values, left as dealt) and ``partition_by``."""
    if not partition_by:
        return rows.write.mode(mode).partitionBy(*first) if first else rows.write.mode(mode)
    # Bring each partition's rows together for few, large files; a partition with a
    # large part of all rows is split into several.
    dealt = rows.hint("rebalance", *partition_by)
    return dealt.write.mode(mode).partitionBy(*first, *partition_by)


def replace_stage(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Create or replace a stage and return it as read back.

    Partition a national run by ``uf``: a run for one state then reads one folder.
    """
    partitioned_writer(rows, "overwrite", partition_by).parquet(path)
    return read_stage(rows.sparkSession, path)


def ordered_writer(
    rows: DataFrame, keys: Sequence[SortKey], lookups: Sequence[str], place: str | None = None
) -> DataFrameWriter:
    """Writer of rows in a total order, with Bloom filters on columns that are looked up.

    ``place`` names a column that tells where in the order a row lies.

    The order narrows the range of the leading keys in each file, so that filters on
    them skip files; the Bloom filters let a lookup of one value skip the rest.
    """
    blooms = {f"parquet.bloom.filter.enabled#{column}": "true" for column in lookups}
    ordered = rows.orderBy(*sort_columns(keys))
    if place:
        ordered = ordered.withColumn(place, F.monotonically_increasing_id())
    return ordered.write.mode("overwrite").options(**blooms)


def replace_ordered_stage(
    rows: DataFrame, path: str, keys: Sequence[SortKey], lookups: Sequence[str]
) -> DataFrame:
    """A stage in a total order, see :func:`ordered_writer`."""
    ordered_writer(rows, keys, lookups).parquet(path)
    return read_stage(rows.sparkSession, path)


def keyed_writer(rows: DataFrame, key: str) -> DataFrameWriter:
    """Writer ordered by a key that many rows may share, for lookups of single keys.

    The scan mark behind the key lets a hot key spread over several files.
    """
    marked = rows.withColumn("_marca", F.monotonically_increasing_id())
    ordered = marked.orderBy(key, "_marca").drop("_marca")
    bloom = {f"parquet.bloom.filter.enabled#{key}": "true"}
    return ordered.write.mode("overwrite").options(**bloom)


def replace_keyed_stage(rows: DataFrame, path: str, key: str) -> DataFrame:
    """A stage ordered by a key, see :func:`keyed_writer`."""
    keyed_writer(rows, key).parquet(path)
    return read_stage(rows.sparkSession, path)


def append_stage(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Add late slices to a stage and return the whole stage."""
    partitioned_writer(rows, "append", partition_by).parquet(path)
    return read_stage(rows.sparkSession, path)


def read_stage(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """A stage, in its current version if it has versions (see :mod:`versions`).

    With a declared schema no file of it is opened while planning.
    """
    return versions.read(spark, path, schema)


def save_keyed_table(rows: DataFrame, table: str, buckets: int, key: str = "cnpj_basico") -> None:
    """Catalog table bucketed and sorted by the company key.

    Tables with the same number of buckets join on the key without a shuffle.
    """
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
