"""Exact positions on skewed data, against a plain sort in Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from garimpo.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    # One company holds a third of the rows, and most of those are one and the same row.
    rows = [("hot", 5 if rng.random() < 0.8 else rng.randrange(50)) for _ in range(4000)]
    rows += [(f"k{rng.randrange(700)}", rng.choice([None, *range(50)])) for _ in range(8000)]
    frame = spark.createDataFrame(rows, "k string, v int").repartition(8)
    return rows, frame.withColumn("copy", F.monotonically_increasing_id())


def expected(rows, by_group):
    ordered = sorted(rows, key=lambda r: (r[0] if by_group else "", r[1] is None, -(r[1] or 0)))
    places, last, place = [], object(), 0
    for k, v in ordered:
        group = k if by_group else None
        place = place + 1 if group == last else 1
        last = group
        places.append((k, v, place) if by_group else (v, place))
    return sorted(places, key=str)


@pytest.mark.parametrize("by_group", [False, True])
def test_positions(skewed, by_group):
    rows, frame = skewed
    keys = [("v", "desc"), ("copy", "asc")]
    if by_group:
        placed = ordering.with_position(frame, keys, by=["k"]).select("k", "v", "posicao")
    else:
        placed = ordering.with_position(frame, keys).select("v", "posicao")
    assert sorted((tuple(r) for r in placed.collect()), key=str) == expected(rows, by_group)


def test_hot_group_spreads_over_partitions(spark, skewed):
    _, frame = skewed
    order = ordering.sort_columns([("v", "desc"), ("copy", "asc")])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [
            r["count"]
            for r in frame.orderBy("k", *order)
            .where("k = 'hot'")
            .groupBy(F.spark_partition_id())
            .count()
            .collect()
        ]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # A third of the rows over eight partitions, four fifths of them exact copies.
    assert sum(sizes) == 4000 and max(sizes) < 2500


@pytest.mark.parametrize("offset, limit", [(0, 7), (95, 20), (11990, 50), (20000, 5)])
def test_deep_slices_equal_shallow_ones(skewed, monkeypatch, offset, limit):
    _, frame = skewed
    keys = [("v", "desc"), ("copy", "asc")]
    shallow = [tuple(r) for r in frame.orderBy(*ordering.sort_columns(keys)).collect()]
    monkeypatch.setattr(ordering, "TOP_K_ROWS", 1)
    deep = ordering.slice_of_order(frame, keys, offset, limit)
    assert [tuple(r) for r in deep.collect()] == shallow[offset : offset + limit]


def test_positions_of_looked_up_rows(spark):
    import random

    from garimpo.operators.ordering import positions_of_looked_up, with_position

    pick = random.Random(3)
    values = [None, None, -5.0, 0.0, 0.4, 1.0, 7.25, 7.5, 1e6, 12345678901234.5]
    words = [None, "", "a", "ab", "abc", "abcd", "abd", "é", "日本語"]
    rows = spark.createDataFrame(
        [(pick.choice("xy"), pick.choice(values), pick.choice(words), i) for i in range(400)],
        "k string, v double, w string, i int",
    )
    for keys in (
        (("v", "desc"), ("w", "asc"), ("i", "asc")), (("w", "asc"), ("v", "asc"), ("i", "asc")),
        (("v", "asc"), ("i", "desc")), (("w", "desc"), ("i", "asc")),
    ):
        got = positions_of_looked_up(rows, keys, "k")
        wanted = with_position(rows, keys, by=["k"])
        assert sorted((r.i, r.posicao) for r in got.collect()) == sorted(
            (r.i, r.posicao) for r in wanted.collect()
        )
