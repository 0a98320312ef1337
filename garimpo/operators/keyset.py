"""The set of company keys that a run needs, as bitmaps of bounded size.

A key has eight digits, so a bit for every possible one is 12.5 MB, however many rows hold
them. Tables by company are cut down to the set before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEYS = 100_000_000
#: Bits of one bitmap of Spark's bitmap functions.
_BITS = 32_768
_BITMAPS = -(-_KEYS // _BITS)


def _number(key: str) -> Column:
    """A key as a number from 1; NULL if it is not eight digits."""
    return F.when(F.col(key).rlike("^[0-9]{8}$"), F.col(key).cast("long") + 1)


def key_set(rows: DataFrame, key: str) -> Column:
    """The keys of ``rows`` as an array of bitmaps, in a scalar subquery."""
    numbered = rows.select(_number(key).alias("_number")).where(F.col("_number").isNotNull())
    bitmaps = numbered.groupBy(F.bitmap_bucket_number("_number").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("_bits")
    )
    by_bucket = F.map_from_entries(F.collect_list(F.struct("_bucket", "_bits")))
    every = F.sequence(F.lit(1).cast("long"), F.lit(_BITMAPS).cast("long"))
    return bitmaps.agg(by_bucket.alias("_map")).select(
        F.transform(every, lambda bucket: F.col("_map")[bucket])
    ).scalar()


def within(rows: DataFrame, key: str, keys: Column) -> DataFrame:
    """Rows whose key is in the set; keys that are not eight digits stay."""
    number = _number(key)
    place = F.bitmap_bit_position(number)
    byte = F.substring(
        F.element_at(keys, F.bitmap_bucket_number(number).cast("int")),
        (place / 8).cast("int") + 1, F.lit(1),
    )
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    bit = F.call_function("shiftright", value, (place % 8).cast("int")) % 2
    return rows.where(number.isNull() | (F.coalesce(bit, F.lit(0)) == 1))
