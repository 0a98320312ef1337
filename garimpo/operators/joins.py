"""Joining rows to a table with one row per key when a key may have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SECOND_KEY = "_segunda_chave"


def join_to_unique(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``many`` to ``one``, which has one row per ``key``; ``how`` is inner or left.

    Adaptive execution splits a hot key over several tasks, but only in a join whose two
    sides both come fresh from a shuffle. ``one`` comes out of joins or aggregates on
    ``key`` and would be used as it lies, leaving the hot key to one task. A second join
    column, computed from the key, has Spark shuffle it once more: narrow rows, one per
    key, beside the wide rows of ``many`` that move anyway. Small sides are broadcast as
    always.
    """
    second = F.hash(key)
    return many.withColumn(_SECOND_KEY, second).join(
        one.withColumn(_SECOND_KEY, second), [key, _SECOND_KEY], how
    ).drop(_SECOND_KEY)
