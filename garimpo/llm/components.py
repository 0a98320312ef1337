"""Connected components by alternating large-star and small-star steps.

A large-star step links every larger neighbour of a node to the least node around it, a
small-star step every smaller one and the node itself. Both keep the components; repeated
in turn they leave one star around the least node of each component, after about as many
rounds as the longest chain has doublings. Neighbours are never listed: a step is a grouped
minimum and a join, which adaptive execution splits at a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.common import stored
from garimpo.operators.joins import join_to_unique


def _link_to_least(arcs: DataFrame) -> DataFrame:
    """Arcs (u, v) with the least of u and all its v as ``m``."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return join_to_unique(arcs, least, "u")


def _edges(pairs: DataFrame) -> DataFrame:
    """Each pair once, larger node first."""
    return (
        pairs.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _link_to_least(both).where("v > u")
    return _edges(linked.select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    linked = _link_to_least(edges)
    to_least = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _edges(to_least.unionAll(linked.select("u", F.col("m").alias("v"))))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and sum of hashes: alike for equal sets of edges."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    row = edges.agg(F.count("*").alias("n"), digest.alias("digest")).first()
    return row.n, row.digest


def components(pairs: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component) of every node of the links (u, v); the least node names it.

    Ids are whole numbers. Pairs may repeat, in either direction; links of a node to itself
    and links with a missing end do not count, and a node with no other has no row.
    """
    present = pairs.where("u is not null and v is not null")
    edges = stored(_edges(present.select("u", "v")), purpose)
    mark = _mark(edges)
    while mark[0]:
        edges = stored(_small_star(_large_star(edges)), purpose)
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(
        stars.select(F.col("component").alias("node"), "component").distinct()
    )
