"""Exact top-k inner products by aggregating sorted lists without random access.

For a query, every dimension is a list of the vectors sorted by what they contribute to its
score. All lists are read from their tops, equally deep. What has been read of a vector
gives it a lower bound (entries not yet seen count as the ends of their lists) and an upper
bound (they count as the last entry read). Once no vector outside the best k by lower bound
has an upper bound that reaches the k-th of these, reading stops; vectors whose bounds leave
them in question are read to the end of their entries, which resolves their scores.

The table is dealt into blocks of vectors, the queries into blocks of queries, and every
pair of blocks is one step: lists are sorted once per block of vectors, and one dimension's
list serves positive weights from one end and negative ones from the other, so the bounds of
all pairs of a step come out of two matrix products per depth. Once few vectors of a block
are in question for a query, reading goes on for these alone. Each step gives at most k rows
a query; a ranking per query merges these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64
K = 20
#: Vectors and queries of a block.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024
#: Depths to which lists are read, one after the other; the last is their end.
DEPTHS = (1 / 16, 1 / 4, 1 / 2, 0.8, 0.9, 0.95, 1)
#: While more than this part of a block is in question, bounds are taken for the whole block.
FEW = 1 / 16

_LONG = np.iinfo(np.int64)


def quantised(vectors: list, dim: int) -> np.ndarray:
    """``floor(SCALE * x)`` of every component, as whole numbers in float64."""
    return np.floor(SCALE * np.array(vectors, np.float64).reshape(len(vectors), dim))


def _number_type(x: np.ndarray, q: np.ndarray):
    """A type in which sums of products are exact; None if only Python's integers are."""
    top = [float(np.abs(a).max()) if a.size else 0.0 for a in (x, q)]
    largest = 2 * top[0] * top[1] * max(1, x.shape[1])
    if largest < 1 << 24:
        return np.float32
    return np.float64 if largest < 1 << 53 else None


class SortedLists:
    """The lists of one block of vectors, one per dimension, largest entry first."""

    def __init__(self, x: np.ndarray):
        self.x = x
        order = np.argsort(-x, axis=0, kind="stable")
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(x))[:, None], axis=0)
        self.entry = np.take_along_axis(x, order, axis=0)

    def bounds(
        self, queries: np.ndarray, depth: int, rows: np.ndarray | slice = slice(None)
    ) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of scores after reading ``depth`` entries of each list."""
        x, rank, n = self.x[rows], self.rank[rows], len(self.x)
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        from_top, from_end = rank < depth, rank >= n - depth
        seen = np.hstack([x * from_top, x * from_end]) @ np.hstack([plus, minus]).T
        unseen = np.hstack([~from_top, ~from_end]).astype(x.dtype)
        last = np.hstack([plus * self.entry[depth - 1], minus * self.entry[n - depth]])
        ends = np.hstack([plus * self.entry[-1], minus * self.entry[0]])
        return seen + unseen @ ends.T, seen + unseen @ last.T

    def whole_at(self, query: np.ndarray, rows: np.ndarray) -> int:
        """The depth at which all entries of these vectors have been read."""
        rank = self.rank[rows]
        deep = np.where(query > 0, rank.max(0) + 1, np.where(query < 0, len(self.x) - rank.min(0), 0))
        return max(1, int(deep.max(initial=0)))


def best_of_block(
    x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int
) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of the k best vectors of a block for each query.

    ``ids`` ascend, so of equal scores the first are the right ones.
    """
    kind = _number_type(x, queries)
    out = []
    if kind is None:  # beyond exact floating point
        whole = [[int(v) for v in row] for row in x]
        for query, number in zip(queries, query_ids):
            weights = [int(v) for v in query]
            scored = sorted(
                (-sum(a * b for a, b in zip(row, weights)), int(i), at)
                for at, (i, row) in enumerate(zip(ids, whole)) if i != number
            )[:k]
            out += [(number, i, min(max(-s, _LONG.min), _LONG.max)) for s, i, _ in scored]
        return out
    x, queries = x.astype(kind), queries.astype(kind)
    n = len(x)
    lists = SortedLists(x)
    open_queries = np.arange(len(queries))
    for read in _depths(n):
        if not len(open_queries):
            break
        bounds = lists.bounds(queries[open_queries], read)
        still = []
        for query, low, high in zip(open_queries, *(np.ascontiguousarray(b.T) for b in bounds)):
            others = np.flatnonzero(ids != query_ids[query])
            rest = others[_in_question(low[others], high[others], k)]
            if len(rest) > max(k, int(n * FEW)) and read < n:
                still.append(query)
            else:
                out += _resolved(lists, ids, queries[query], query_ids[query], rest, k, read)
        open_queries = np.array(still, np.int64)
    return out


def _depths(n: int) -> list[int]:
    return [max(1, int(n * depth)) for depth in DEPTHS]


def _in_question(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Places of the vectors whose upper bound reaches the k-th best lower bound."""
    if len(low) <= k:
        return np.arange(len(low))
    return np.flatnonzero(high >= np.partition(low, len(low) - k)[len(low) - k])


def _resolved(lists, ids, query, number, rest, k, read):
    """The k best of the vectors in question: the lists are read on for these alone.

    First until no other is in question or the lists end, then to the last entry of those
    that are left, where both bounds meet in the score.
    """
    if not len(rest):
        return []
    for depth in _depths(len(lists.x)):
        if depth > read and len(rest) > k:
            low, high = lists.bounds(query[None], depth, rest)
            rest = rest[_in_question(low[:, 0], high[:, 0], k)]
    scores, _ = lists.bounds(query[None], lists.whole_at(query, rest), rest)
    return _top(scores[:, 0], ids[rest], number, k)


def _top(scores, ids, number, k):
    others = ids != number
    scores, ids = scores[others], ids[others]
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
        scores, ids = scores[kept], ids[kept]
    order = np.lexsort((ids, -scores))[:k]
    return [(int(number), int(ids[i]), int(scores[i])) for i in order]


def _step(k: int, names: tuple[str, str]):
    def work(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        if vectors.num_rows and queries.num_rows:
            dim = vectors["dim"][0].as_py()
            ids = vectors[names[0]].to_numpy()
            order = np.argsort(ids, kind="stable")
            x = _matrix(vectors[names[1]], dim)[order]
            q = _matrix(queries[names[1]], dim)
            rows = best_of_block(x, ids[order], q, queries[names[0]].to_numpy(), k)
        columns = list(zip(*rows)) if rows else [(), (), ()]
        return pa.table(
            [pa.array(column, pa.int64()) for column in columns],
            names=["query_id", "vec_id", "score"],
        )

    return work


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat.astype(np.float64)).reshape(len(column), dim)


def top_k(
    vectors: DataFrame, k: int = K, every: int = 20, vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query, ties to the lesser id.

    Queries are the ids divisible by ``every``; candidates are all rows but those with the
    query's id. Vectors that are missing, or hold a missing or non-finite component, and
    rows without id take no part. A vector meets those of its own length. Of several vectors
    with a query's id the least asks; as candidates all rows count, repeated ones as often
    as they are there. Scores beyond a long number stay at its ends. Other columns are left
    out; an empty table, or one without queries, gives an empty result.
    """
    fine = F.forall(
        embedding,
        lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")),
    )
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & fine).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"),
        F.size(embedding).alias("dim"),
    )
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = asked.withColumn("dim", F.size("embedding"))
    n, m = rows.count(), asked.count()
    vector_blocks, query_blocks = max(1, -(-n // BLOCK_VECTORS)), max(1, -(-m // BLOCK_QUERIES))

    def dealt(part: DataFrame, own: str, own_blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(own_blocks))
        return part.withColumn(own, block).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
        )

    left = dealt(rows, "vector_block", vector_blocks, "query_block", query_blocks)
    right = dealt(asked, "query_block", query_blocks, "vector_block", vector_blocks)
    keys = ["dim", "vector_block", "query_block"]
    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(
            _step(k, ("vec_id", "embedding")), "query_id bigint, vec_id bigint, score bigint"
        )
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
