"""Resharding by minimum-cost flow: the fewest bytes move to make shards equal.

Old shards hold bytes, new ones have capacities. Bytes flow from old to new; staying where
one is costs nothing, moving costs a unit a byte. The cheapest flow is found by shortest
augmenting paths; it has at most as many parts as there are shards, old and new. Each old
shard is then cut into blocks of documents, one for each part that leaves it, and the rest
stays. A cut misses its byte by less than one document; what the cuts missed is settled by
the same step on the new sizes, now with small documents first in each shard, so that a few
of the smallest move and hardly anything is missed.

A document's place in its shard comes from sums over buckets of equal size class, spread by
hash: no task sees a whole shard in order. The flow sees shard sizes alone.

Shards are folders ``shard=<number>`` of Parquet files. Those that lose or gain documents are
written anew with the texts that flowed in; the files of all others stay where they are.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from garimpo.llm.common import as_bytes, stored
from garimpo.plans.session import work_folder

#: Bytes that a document takes beside its text.
OVERHEAD = 8
NEW_SHARDS = 24
#: Shards of the layout that the query starts from.
OLD_SHARDS = 18
#: Rows of a bucket, about.
BUCKET_ROWS = 20_000
#: Passes over the sizes; each leaves less to move than the one before.
PASSES = 6

#: (old shard, first byte, byte after the last, new shard).
Move = tuple[int, int, int, int]


def cheapest_flow(
    sizes: Mapping[int, int], capacities: Mapping[int, int]
) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, moving as few as possible.

    ``capacities`` add up to ``sizes``. Costs are 0 and 1, so a path of least cost is found
    by a breadth-first search that takes free arcs first.
    """
    left = {i: size for i, size in sizes.items() if size}
    room = dict(capacities)
    flow: dict[tuple[int, int], int] = {}

    def add(i: int, j: int, amount: int) -> None:
        flow[i, j] = flow.get((i, j), 0) + amount
        if not flow[i, j]:
            del flow[i, j]

    while left:
        # Nodes are ("old", i) and ("new", j); arcs back undo flow and give its cost back.
        cost = {("old", i): 0 for i in left}
        came: dict = {}
        queue = deque(cost)
        while queue:
            node = queue.popleft()
            side, a = node
            if side == "old":
                steps = [(("new", j), int(a != j)) for j in room]
            else:
                steps = [(("old", i), -int(i != a)) for i, j in flow if j == a]
            for step, price in steps:
                if cost[node] + price < cost.get(step, 1 << 60):
                    cost[step] = cost[node] + price
                    came[step] = node
                    queue.append(step)
        ends = [j for j in room if room[j] and ("new", j) in cost]
        end = min(ends, key=lambda j: (cost["new", j], j))
        path = [("new", end)]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(left[path[0][1]], room[end])
        for (side, a), (_, b) in zip(path, path[1:]):
            if side == "new":
                amount = min(amount, flow[b, a])
        for (side, a), (_, b) in zip(path, path[1:]):
            add(*((a, b, amount) if side == "old" else (b, a, -amount)))
        room[end] -= amount
        left[path[0][1]] -= amount
        if not left[path[0][1]]:
            del left[path[0][1]]
    return flow


def even_capacities(total: int, shards: int) -> dict[int, int]:
    """Sizes that differ by one byte at most."""
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def moves_of(flow: Mapping[tuple[int, int], int]) -> list[Move]:
    """The flow as byte ranges of old shards, those that leave first; the rest stays."""
    out: list[Move] = []
    at: dict[int, int] = {}
    for (old, new), amount in sorted(flow.items()):
        if old != new:
            start = at.get(old, 0)
            out.append((old, start, start + amount, new))
            at[old] = start + amount
    return out


def _shard_sizes(rows: DataFrame) -> dict[int, int]:
    """Bytes of every shard: one row each."""
    return {r.shard: r.size for r in rows.groupBy("shard").agg(F.sum("size").alias("size")).collect()}


def _buckets_of(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // BUCKET_ROWS))


def _spread(buckets: int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(buckets))


def _first_bytes(rows: DataFrame, buckets: int, small_first: bool) -> DataFrame:
    """``rows`` with ``start``: the bytes that lie before a row in its shard.

    Ordered by size class if ``small_first``, then bucket, then row.
    """
    size_class = F.length(F.bin("size")) if small_first else F.lit(0)
    dealt = rows.withColumns({"size_class": size_class, "bucket": _spread(buckets)})
    key = ["shard", "size_class", "bucket"]
    sums = dealt.groupBy(*key).agg(F.sum("size").alias("bytes"))
    order = Window.partitionBy("shard").orderBy("size_class", "bucket")
    before = sums.select(*key, (F.sum("bytes").over(order) - F.col("bytes")).alias("before"))
    inside = Window.partitionBy(*key).orderBy("row")
    return (
        dealt.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
        .join(before, key)
        .withColumn("start", F.col("before") + F.col("inside"))
        .drop("size_class", "bucket", "before", "inside")
    )


def reshard(rows: DataFrame, shards: int = NEW_SHARDS) -> DataFrame:
    """``rows`` with new values in ``shard``, 0 to ``shards - 1``, near equal in bytes.

    Takes columns ``row`` (a unique number), ``size`` and ``shard`` (where the row is now)
    among others. An empty table stays empty.
    """
    now = rows
    buckets = _buckets_of(rows)
    for done in range(PASSES):
        sizes = _shard_sizes(now)
        capacities = even_capacities(sum(sizes.values()), shards)
        moves = moves_of(cheapest_flow(sizes, capacities))
        if not moves:
            break
        moving = max(end for _, _, end, _ in moves)
        target = F.col("shard")
        for old, start, end, new in moves:
            inside = (F.col("shard") == old) & (F.col("start") >= start) & (F.col("start") < end)
            # A row that reaches past the middle of itself stays with the next block.
            target = F.when(inside & (F.col("start") + F.col("size") / 2 <= end), new).otherwise(target)
        placed = _first_bytes(now, buckets, done > 0).withColumn("shard", target).drop("start")
        now = stored(placed, "resharded")
        if moving <= 64:
            break
    return now


def with_slots(rows: DataFrame, by: str = "shard") -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in every shard; ordered by bucket and row."""
    dealt = rows.withColumn("bucket", _spread(_buckets_of(rows)))
    counts = dealt.groupBy(by, "bucket").agg(F.count("*").alias("rows"))
    order = Window.partitionBy(by).orderBy("bucket")
    before = counts.select(by, "bucket", (F.sum("rows").over(order) - F.col("rows")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(by, "bucket").orderBy("row")) - 1
    return (
        dealt.withColumn("inside", inside)
        .join(before, [by, "bucket"])
        .withColumn("slot", F.col("before") + F.col("inside"))
        .drop("bucket", "before", "inside")
    )


def _size(text: str) -> Column:
    return (F.octet_length(as_bytes(text)) + OVERHEAD).cast("long")


def _changed(plan: DataFrame) -> list[int]:
    """Numbers of the shards that lose or gain rows; ``plan`` has ``old`` and ``shard``."""
    moved = plan.where("old <> shard").select(F.explode(F.array("old", "shard")).alias("shard"))
    return sorted(r.shard for r in moved.distinct().collect())


def _write_changed(
    rows: DataFrame, plan: DataFrame, key: list[str], columns: list[str], new: str,
    compression: str | None = None,
) -> list[int]:
    """Bring the rows of all changed shards to where ``plan`` puts them, below ``new``.

    ``rows`` lie in ``shard``; ``key`` names them there and in ``plan``; ``columns`` are
    written. Texts are shuffled once, by key, and a task writes what it has of each shard:
    no task has a whole one. Returns the numbers of these shards.
    """
    changed = _changed(plan)
    target = plan.where(F.col("shard").isin(changed)).select(*key, "shard")
    (
        rows.where(F.col("shard").isin(changed))
        .drop("shard")
        .join(target.hint("merge"), key)  # a plan grows with its table, so it is not broadcast
        .select(*columns, "shard")
        .write.partitionBy("shard").mode("errorifexists").parquet(new, compression=compression)
    )
    return changed


def reshard_texts(
    docs: DataFrame, old_shard: Column, shards: int = NEW_SHARDS, text: str = "text"
) -> DataFrame:
    """doc_id, text, row and shard of every row, read from the files of its new shard.

    The documents are laid out by ``old_shard`` first, a folder for each shard. ``row`` is
    a number of its own for each row.
    """
    spark = docs.sparkSession
    old, new = work_folder(spark, "old-shards"), work_folder(spark, "new-shards")
    laid = docs.select(
        "doc_id", F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"),
        old_shard.cast("int").alias("shard"),
    )
    laid.write.partitionBy("shard").parquet(old, compression="zstd")
    there = spark.read.schema(laid.schema).parquet(old)
    sizes = there.select("row", _size("text").alias("size"), "shard", F.col("shard").alias("old"))
    # In the order of the documents: it decides between flows of the same cost.
    plan = reshard(stored(sizes.orderBy("row"), "shard-rows"), shards)
    changed = _write_changed(there, plan, ["row"], ["doc_id", "text", "row"], new, "zstd")
    return spark.read.schema(laid.schema).parquet(new).unionByName(
        there.where(~F.col("shard").isin(changed))
    )


def reshard_documents(
    docs: DataFrame, old_shard: Column, shards: int = NEW_SHARDS, text: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Sizes and checksums are those of the texts as they lie in their new shards. The law is
    ``bytes``: shards are near equal in bytes, whatever the old layout was. A missing text
    counts as empty; missing ids and equal rows are rows like any other; other columns are
    left out; an empty table gives an empty one.
    """
    placed = with_slots(
        reshard_texts(docs, old_shard, shards, text).select(
            "doc_id", _size("text").alias("size"),
            F.crc32(as_bytes("text")).alias("text_crc32"), "row", "shard",
        )
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
        F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"),
    )


# Files ------------------------------------------------------------------------------


def reshard_folder(
    spark: SparkSession, old: str, new: str, shards: int = NEW_SHARDS, text: str = "text"
) -> DataFrame:
    """Bring a folder of ``shard=<number>`` Parquet parts to ``shards`` equal shards.

    Shards that lose or gain documents are written below ``new``; the files of all others
    stay as they are. Returns (shard, folder): where each shard lies now. ``old`` is not
    changed, so readers of it are not disturbed and the step can be run again.
    """
    try:
        rows = spark.read.parquet(old)
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return spark.createDataFrame([], "shard int, folder string")
        raise
    key = {"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")}
    keyed = rows.withColumns(key)
    sizes = keyed.select(
        *key, _size(text).alias("size"), "shard", F.monotonically_increasing_id().alias("row"),
        F.col("shard").alias("old"),
    )
    plan = reshard(stored(sizes, "shard-rows"), shards)
    columns = [name for name in rows.columns if name != "shard"]
    changed = _write_changed(keyed, plan, [*key], columns, new)
    return spark.createDataFrame(
        [(j, f"{new if j in changed else old}/shard={j}") for j in range(shards)],
        "shard int, folder string",
    )
