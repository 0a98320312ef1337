"""Prefix trie of conversations from vertical bitmaps.

A node of depth d is a distinct sequence of first d turns; its members are the conversations
that start with it. Conversations are numbered in the order of their ids and dealt into
shards of consecutive numbers. A shard has one bitmap for every (position, turn): which of
its conversations have that turn there. Depth first from the set of all, a node's set is
intersected with the bitmaps of the next position: every intersection that is not empty is a
child, its bits counted are the members, and bits of conversations that end there are the
node's list of ends. What shards find of one node is then added up; lists of ends only have
to be put behind each other, for shards are ranges of ids.

Positions are cut into blocks, and a shard is walked once per block, so that a conversation
with a large part of all turns spreads over many groups. A block starts from the sets of
conversations that agree so far: the key of a node is the exclusive-or of hashes of its
(position, turn) pairs, 128 bits, and that of a whole block is known before it is walked.

Sums over subtrees need no walk of the merged tree. A node's owner is its smallest member.
What a conversation owns is the end of its path, so a node's sum is what its members own in
all, without what its owner owns above it.

Conversations are ordered by one range sort of narrow rows, not by group, so a conversation
or id with a third of all rows is no single task either. One thing is: the digest of the
ends of one node runs over all its ids in order; it is streamed from rows of at most a
shard's ids each.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.llm.common import stored
from garimpo.operators.joins import join_to_unique

#: Conversations of a shard and positions of a block; they bound what a task holds.
SHARD, BLOCK = 1024, 256
#: Conversations of this many consecutive ids start alike, for up to this many turns.
FAMILY, SHARED = 5, 9


def _turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest of role and text, bytes of the text."""
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.sha2(said.cast("binary"), 256)).alias("said"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def _numbered_parts(rows: DataFrame, purpose: str) -> DataFrame:
    """Rows of a sorted frame with ``_part``, its sort partition, written out once."""
    return stored(
        rows.withColumn("_place", F.monotonically_increasing_id()), purpose
    ).withColumn("_part", F.shiftright("_place", 33))


def _before(runs: DataFrame, by: list[str], rows: str, name: str) -> DataFrame:
    """``runs`` (per part) with the rows of earlier parts, overall or within ``by``."""
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("_part")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn(name, F.coalesce(F.sum(rows).over(earlier), F.lit(0)))


def ordered_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their position from 0, and conversations with their length and number.

    Turns stand in order of ``turn``, NULL first; of equal ones by role, then by digest.
    """
    ordered = _numbered_parts(
        _turns(rows).orderBy("conv_id", F.asc_nulls_first("turn"), "role", "said")
        .drop("turn", "role"),
        "trie-turns",
    )
    runs = ordered.groupBy("conv_id", "_part").agg(
        F.count("*").alias("_rows"), F.min("_place").alias("_first")
    )
    runs = stored(_before(runs, ["conv_id"], "_rows", "_earlier"), "trie-runs")
    convs = runs.groupBy("conv_id").agg(
        F.sum("_rows").alias("length"), F.min("_part").alias("_part")
    )
    # The number of a conversation: those that start in earlier parts, one row per part,
    # and its rank in its own, both by id, for parts are ranges of ids.
    starts = convs.groupBy("_part").agg(F.count("*").alias("_convs"))
    starts = _before(starts, [], "_convs", "_convs_before").select("_part", "_convs_before")
    in_part = Window.partitionBy("_part").orderBy("conv_id")
    numbers = convs.join(F.broadcast(starts), "_part").select(
        "conv_id", "length",
        (F.col("_convs_before") + F.row_number().over(in_part) - 1).alias("number"),
    )
    placed = ordered.join(runs.drop("_rows"), ["conv_id", "_part"]).select(
        "conv_id", "said", "n_bytes",
        (F.col("_place") - F.col("_first") + F.col("_earlier")).alias("position"),
    )
    return placed, stored(numbers, "trie-conversations")


def shared_turns(conv_id: Column) -> Column:
    """How many first turns of its family's first conversation a conversation takes."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations as rebuilt: the family's first turns, then one's own.

    ``turns`` has a row per rebuilt turn, with its new position and whether it is the last.
    A conversation without any turn is in ``convs`` alone, with length 0.
    """
    heads = convs.select("conv_id", F.least("length", F.lit(SHARED - 1)).alias("_head"))
    heads = heads.where(F.pmod("conv_id", F.lit(FAMILY)) == 0).withColumnRenamed("conv_id", "_of")
    wanted = convs.select(
        "conv_id", "number", "length",
        (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("_of"),
        shared_turns(F.col("conv_id")).alias("_shared"),
    )
    # One row per family at most on the right, FAMILY rows on the left.
    plan = wanted.join(heads, "_of", "left").withColumn(
        "_taken", F.least("_shared", F.coalesce("_head", F.lit(0)))
    )
    own_left = F.greatest(F.col("length") - F.col("_shared"), F.lit(0))
    plan = stored(
        plan.select(
            "conv_id", "number", "_of", "_taken", "_shared",
            (F.col("_taken") + own_left).alias("length"),
        ),
        "trie-rebuilt",
    )
    # At most SHARED - 1 turns of a family's first conversation, for FAMILY takers.
    given = turns.where(
        (F.col("position") < SHARED - 1) & (F.pmod("conv_id", F.lit(FAMILY)) == 0)
    ).withColumnRenamed("conv_id", "_of")
    taken = plan.where(F.col("_taken") > 0).join(given, "_of").where(
        F.col("position") < F.col("_taken")
    )
    own = join_to_unique(turns, plan, "conv_id").where(F.col("position") >= F.col("_shared"))
    own = own.withColumn("position", F.col("position") - F.col("_shared") + F.col("_taken"))
    columns = ["conv_id", "number", "position", "said", "n_bytes", "length"]
    every = taken.select(*columns).unionAll(own.select(*columns))
    return every, plan.select("conv_id", "number", "length")


_ROOT_KEY = b"\0" * 16

_LOCAL_NODE = (
    T.StructType().add("node", "binary").add("parent", "binary").add("depth", "long")
    .add("shard", "long").add("n_convs", "long").add("conv_id", "long").add("n_bytes", "long")
    .add("members", T.ArrayType(T.LongType())).add("ends", T.ArrayType(T.LongType()))
)


def _bits(places: np.ndarray, size: int) -> int:
    """A set of places as one whole number."""
    flags = np.zeros(size, bool)
    flags[places] = True
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _places(bits: int, size: int) -> np.ndarray:
    """The places of a set, in order."""
    flags = np.frombuffer(bits.to_bytes((size + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(flags, bitorder="little"))


class _Postings:
    """The vertical bitmaps of a group: per position, the sets of those with each turn."""

    def __init__(self, position: np.ndarray, key: np.ndarray, place: np.ndarray, size: int):
        self.size = size
        order = np.lexsort((key["b"], key["a"], position))
        position, key, self._row = position[order], key[order], order
        new = np.ones(len(order), bool)
        new[1:] = (position[1:] != position[:-1]) | (key[1:] != key[:-1])
        self._of_row = np.empty(len(order), np.int64)
        self._of_row[order] = np.cumsum(new) - 1
        self.sets = [
            _bits(places, size) for places in np.split(place[order], np.flatnonzero(new)[1:])
        ]
        self.key = [x.tobytes() for x in key[new]]
        #: Which set a conversation is in at a position, and who has any turn there.
        self.turn_of: dict[int, dict[int, int]] = {}
        for p, who, number in zip(position.tolist(), place[order].tolist(),
                                  self._of_row[order].tolist()):
            self.turn_of.setdefault(p, {})[who] = number
        self.any = {p: _bits(np.fromiter(who, np.int64), size) for p, who in self.turn_of.items()}

    def children(self, members: int, position: int) -> Iterator[tuple[int, int]]:
        """(number of the turn, members) of every child of a node with these members."""
        left = members & self.any.get(position, 0)
        while left:
            first = (left & -left).bit_length() - 1
            number = self.turn_of[position][first]
            child = left & self.sets[number]
            yield number, child
            left &= ~child


_KEY = np.dtype([("a", "<i8"), ("b", "<i8")])


def _mixed(one: bytes, other: bytes) -> bytes:
    both = int.from_bytes(one, "little") ^ int.from_bytes(other, "little")
    return both.to_bytes(16, "little")


def _walk(rows: pa.Table, block_size: int) -> pa.Table:
    """Nodes of one shard and block, depth first."""
    shard, block = rows.column("shard")[0].as_py(), rows.column("block")[0].as_py()
    conv = rows.column("conv_id").to_numpy()
    ids, place = np.unique(conv, return_inverse=True)
    size = len(ids)
    has_turn = np.asarray(rows.column("position").is_valid())
    turns = rows.filter(pa.array(has_turn))
    position = turns.column("position").to_numpy()
    who = place[has_turn]
    key = np.zeros(len(turns), _KEY)
    key["a"], key["b"] = turns.column("k1").to_numpy(), turns.column("k2").to_numpy()
    n_bytes = turns.column("n_bytes").to_numpy()
    last = position + 1 == turns.column("length").to_numpy()
    postings = _Postings(position, key, who, size)
    bytes_of = np.zeros(len(postings.sets), np.int64)
    bytes_of[postings._of_row] = n_bytes
    ending: dict[int, int] = {}
    for p in np.unique(position[last]).tolist():
        ending[p + 1] = _bits(who[last & (position == p)], size)

    # Where the block starts: sets that agree so far, by the key of their common node.
    begin = np.zeros(size, _KEY)
    begin["a"][place] = rows.column("b1").to_numpy()
    begin["b"][place] = rows.column("b2").to_numpy()
    starts, group = np.unique(begin, return_inverse=True)
    first = block * block_size
    out: dict[str, list] = {name: [] for name in _LOCAL_NODE.names}

    def emit(node: bytes, parent: bytes | None, depth: int, members: int, size_of: int, ends: int):
        those = ids[_places(members, size)]
        out["node"].append(node)
        out["parent"].append(parent)
        out["depth"].append(depth)
        out["shard"].append(shard)
        out["n_convs"].append(members.bit_count())
        out["conv_id"].append(int(those[0]))
        out["n_bytes"].append(size_of)
        out["members"].append(those)
        out["ends"].append(ids[_places(ends, size)])

    for number in range(len(starts)):
        members = _bits(np.flatnonzero(group == number), size)
        node = starts[number].tobytes()
        if block == 0:
            emit(node, None, 0, members, 0, members & ~postings.any.get(0, 0))
        stack = [(node, postings.children(members, first), first)]
        while stack:
            node, children, depth = stack[-1]
            found = next(children, None)
            if found is None:
                stack.pop()
                continue
            turn, members = found
            child, depth = _mixed(node, postings.key[turn]), depth + 1
            emit(child, node, depth, members, int(bytes_of[turn]), members & ending.get(depth, 0))
            stack.append((child, postings.children(members, depth), depth))
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_LOCAL_NODE)
    return pa.table([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)


def local_nodes(
    turns: DataFrame, convs: DataFrame, shard: int = SHARD, block: int = BLOCK
) -> DataFrame:
    """Nodes of every shard by vertical bitmaps: key, parent's key, depth, members, ends."""
    position = F.col("position")
    keyed = turns.select(
        "conv_id", (F.col("number") / shard).cast("long").alias("shard"),
        (position / block).cast("long").alias("block"), "position", "n_bytes", "length",
        F.xxhash64(F.lit(1), position, "said").alias("k1"),
        F.xxhash64(F.lit(2), position, "said").alias("k2"),
    )
    # Keys at the start of each block: exclusive-or of the blocks before. Few rows: one per
    # conversation and block.
    per_block = keyed.groupBy("conv_id", "block").agg(
        F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2")
    )
    upto = Window.partitionBy("conv_id").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    begins = per_block.select(
        "conv_id", "block",
        F.bit_xor("x1").over(upto).alias("b1"), F.bit_xor("x2").over(upto).alias("b2"),
    ).where(F.col("block") > 0)
    walked = keyed.join(begins, ["conv_id", "block"], "left")
    none = F.lit(None).cast("long")
    turnless = convs.where(F.col("length") == 0).select(
        "conv_id", (F.col("number") / shard).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("block"), none.alias("position"), none.alias("n_bytes"),
        "length", none.alias("k1"), none.alias("k2"), none.alias("b1"), none.alias("b2"),
    )
    columns = turnless.columns
    rows = walked.select(*columns).unionAll(turnless).fillna(0, ["b1", "b2"])
    return rows.groupBy("shard", "block").applyInArrow(
        lambda group: _walk(group, block), _LOCAL_NODE
    )


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): ids in order, streamed from the shards' lists."""
    schema = T.StructType().add("node", "binary").add("ends_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def row(names, digests):
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(digests, pa.string())],
                names=schema.names,
            )

        for batch in batches:
            names, digests = [], []
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ends")):
                text = ",".join(map(str, ids.as_py()))
                if name == node:
                    digest.update(b"," + text.encode())
                    continue
                if node is not None:
                    names.append(node)
                    digests.append(digest.hexdigest())
                node, digest = name, sha256(text.encode())
            yield row(names, digests)
        if node is not None:
            yield row([node], [digest.hexdigest()])

    dealt = ends.repartition("node").sortWithinPartitions("node", "shard")
    return dealt.select("node", "ends").mapInArrow(run, schema)


def merged_nodes(local: DataFrame) -> DataFrame:
    """One row per node: what its shards hold added up, and its children counted."""
    nodes = local.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        F.first("parent").alias("parent"), F.sum("n_convs").alias("n_convs"),
        F.first("n_bytes").alias("n_bytes"),
    )
    return stored(nodes, "trie-nodes")


def _above(owned: DataFrame, block: int) -> DataFrame:
    """What the owner of a node owns at smaller depths, by blocks of depths."""
    blocks = owned.withColumn("_block", (F.col("depth") / block).cast("long"))
    inside = (
        Window.partitionBy("conv_id", "_block").orderBy("depth")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        Window.partitionBy("conv_id").orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = blocks.groupBy("conv_id", "_block").agg(F.sum("saved").alias("_saved"))
    sums = sums.select("conv_id", "_block", F.sum("_saved").over(across).alias("_earlier"))
    within = blocks.withColumn("_within", F.sum("saved").over(inside))
    above = F.coalesce("_within", F.lit(0)) + F.coalesce("_earlier", F.lit(0))
    return within.join(sums, ["conv_id", "_block"]).withColumn("_above", above).drop(
        "_block", "_within", "_earlier"
    )


def trie(conversations: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Every node of the trie of the rebuilt conversations.

    ``conv_id``, its smallest member; ``depth``; ``parent_conv_id``, that of its parent (the
    root has none); ``n_convs``, members; ``n_children``; ``n_leaves``, nodes without
    children in its subtree, itself included; ``saved_tokens``, the bytes that its subtree
    stores once instead of once per member; ``ends_sha256``, the digest of the ids of
    members that end there.

    Rows without a ``conv_id`` belong to no conversation and take no part. A missing role or
    text is empty. Rows of one conversation with equal ``turn`` stand by role and then by a
    digest of role and text; repeated rows are turns like any other. A conversation may be
    rebuilt without turns: a member of the root. An empty table has no nodes. Columns
    other than ``conv_id``, ``turn``, ``role`` and ``text`` are left out.
    """
    placed, convs = ordered_turns(conversations.select("conv_id", "turn", "role", "text"))
    turns, convs = rebuilt(placed, convs)
    local = stored(local_nodes(turns, convs, shard, block), "trie-local")
    nodes = merged_nodes(local.drop("members", "ends"))

    children = nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(
        F.count("*").alias("n_children")
    )
    known = nodes.join(
        children.withColumnRenamed("parent", "node"), "node", "left"
    ).fillna(0, ["n_children"])
    leaf = (F.col("n_children") == 0).cast("long")
    known = stored(
        known.withColumns(
            {"leaf": leaf, "saved": (F.col("n_convs") - 1) * F.col("n_bytes")}
        ),
        "trie-known",
    )

    owners = known.groupBy("conv_id").agg(
        F.sum("saved").alias("_all_saved"), F.sum("leaf").alias("_leaves")
    )
    members = local.select("node", F.explode("members").alias("conv_id"))
    sums = join_to_unique(members, owners, "conv_id").groupBy("node").agg(
        F.sum("_all_saved").alias("_all_saved"), F.sum("_leaves").alias("n_leaves")
    )
    parents = known.select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")
    )
    ends = _ends_digest(local.where(F.size("ends") > 0).select("node", "shard", "ends"))
    out = join_to_unique(_above(known, block).join(sums, "node"), parents, "parent", "left")
    out = out.join(ends, "node", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("_all_saved") - F.col("_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
