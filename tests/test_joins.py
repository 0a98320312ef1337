from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from garimpo.operators.joins import join_to_unique

# So low that the small test data counts as large and skewed.
LOW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5000",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_key_is_split(spark, how):
    saved = {name: spark.conf.get(name, None) for name in LOW}
    for name, value in LOW.items():
        spark.conf.set(name, value)
    try:
        # A third of all rows on one key.
        number = F.col("id")
        many = spark.range(0, 60000, 1, 8).select(
            F.when(number % 3 == 0, F.lit("hot")).otherwise(number.cast("string")).alias("k"),
            F.sha2(number.cast("string"), 256).alias("wide"),
        )
        # One row per key, out of an aggregate.
        even = spark.range(0, 60000, 2, 8).select(
            F.when(number == 0, F.lit("hot")).otherwise(number.cast("string")).alias("k")
        )
        one = even.groupBy("k").agg(F.count("*").alias("n"))
        joined = join_to_unique(many, one, "k", how)
        counts = joined.agg(
            F.count("*").alias("rows"),
            F.count_if(F.col("k") == "hot").alias("hot"),
            F.count("n").alias("matched"),
            F.max("wide").alias("kept_wide"),
        )
        row = counts.collect()[0]
        plan = counts._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in saved.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    assert (row.hot, row.matched) == (20000, 40000)
    assert row.rows == (40000 if how == "inner" else 60000)
    assert "skew=true" in plan


def test_key_bitmaps_cut_tables_down(spark):
    from garimpo.operators.keyset import key_set, within

    wanted = ["00000000", "99999999", "00032767", "00032768", "00065536", "1234567", "AB345678"]
    keys = spark.createDataFrame([(k,) for k in [*wanted, None]], "k string")
    rows = spark.range(0, 100_000_000, 4096).selectExpr("lpad(id, 8, '0') AS k").unionAll(keys)
    got = within(rows, "k", key_set(keys, "k")).distinct().collect()
    assert {r.k for r in got} == {*wanted, None}
    none = within(rows, "k", key_set(keys.limit(0), "k"))
    # Keys that are not eight digits cannot be told and stay.
    assert {r.k for r in none.collect()} == {"1234567", "AB345678", None}
