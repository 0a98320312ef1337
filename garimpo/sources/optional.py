"""Stand-ins for sources that were not loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that the optimizer knows to be empty: its joins vanish."""
    columns = [
        F.lit(None).cast(field.dataType).alias(field.name)
        for field in T.StructType.fromDDL(schema)
    ]
    return spark.sql("SELECT 1").where(F.lit(False)).select(*columns)
