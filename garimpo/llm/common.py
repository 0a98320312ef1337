"""What the operators of this package share: tables in, stored steps, words of a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.plans.session import work_folder

#: Rows that one Python step looks at together; bounds what a task holds beside its batch.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """Write rows to the shared folder and read them back: later steps start from there.

    The schema is given, so an empty table comes back with its columns.
    """
    path = work_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def doc_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; NULL for a missing id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def as_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text; a missing text is empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: exactly what ``bytes.split`` parts by."""
    return text.split()


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def plainly_named(rows: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``rows`` with names that clash with nothing, and the new name of each column."""
    names = {name: f"_c{place}" for place, name in enumerate(rows.columns)}
    return rows.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()]), names


def map_batches(
    rows: DataFrame,
    make: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    schema: T.StructType,
    keep: Sequence[str] = (),
    also: Sequence[str] = (),
) -> DataFrame:
    """Add computed columns to rows, a few rows at a time.

    ``make`` runs once per task and gives a function from the input columns (as lists,
    without those of ``keep`` that ``also`` does not name) to the columns of ``schema``.
    Columns of ``keep`` are handed on as they are and stand first.
    """
    kept = T.StructType([rows.schema[name] for name in keep])
    out = T.StructType([*kept.fields, *schema.fields])
    read = [name for name in rows.columns if name not in keep or name in also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        work = make()
        added = to_arrow_schema(schema)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                got = work({name: part.column(name).to_pylist() for name in read})
                arrays = [part.column(name) for name in keep]
                arrays += [pa.array(got[f.name], type=f.type) for f in added]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *added.names])

    return rows.mapInArrow(run, out)
