"""Chat formatting as prefix trees: shared turns once, positions, attention intervals.

Conversations that start with the same turns are paths of one tree. A tree is laid out depth
first in a row of text (a pack), every node's text once; a node knows the position that its
first character has on its own path, and the intervals of the pack that its characters may
look at: those of its ancestors. A conversation is read back from its last node: the text of
its intervals and its own.

Every turn gets a key that chains the keys of the turns before it, so equal keys mean equal
starts. Sorted by the keys of their first turns, conversations of a tree lie side by side in
depth-first order, and packs are built in one pass over the sorted turns, with the current
path in memory. A pack is closed once it holds enough characters or conversations; what the
next pack needs of the tree is written again there. So a first turn that a third of all
conversations share fills many packs in many tasks, and each pack shares it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.llm.common import map_batches

#: Characters, beside those of its first conversation, and conversations after which a pack
#: is closed.
PACK_CHARS, PACK_CONVERSATIONS = 16_384, 512
#: Turns whose keys order the conversations.
KEY_TURNS = 16

ROLES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"),
         "assistant": ("[ANS]", "</s>")}
_OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")

# No mark can stand inside a text: these characters only occur there after a backslash.
_CONTROL = re.compile(r"[\\\[\]<]")
_TEXT = r"((?:[^\\\[\]<]++|\\.)*+)"
_TURN = re.compile(
    "|".join(
        [f"{re.escape(a)}{_TEXT}{re.escape(b)}" for a, b in ROLES.values()]
        + [f"{re.escape(_OTHER[0])}{_TEXT}{re.escape(_OTHER[1])}{_TEXT}{re.escape(_OTHER[2])}"]
    ),
    re.DOTALL,
)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and where its text begins and ends in it."""
    body = escape(text)
    if role in ROLES:
        before, after = ROLES[role]
    else:
        before, after = _OTHER[0] + escape(role) + _OTHER[1], _OTHER[2]
    return before + body + after, len(before), len(before) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, place = [], 0
    names = list(ROLES)
    while place < len(formatted):
        found = _TURN.match(formatted, place)
        if not found:
            raise ValueError(f"no turn at character {place}")
        kind = found.lastindex
        if kind <= len(names):
            turns.append((names[kind - 1], unescape(found[kind])))
        else:
            turns.append((unescape(found[kind - 1]), unescape(found[kind])))
        place = found.end()
    return turns


# Sorting turns by shared starts ----------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            yield from zip(*(column.to_pylist() for column in part.columns))


def _batches(rows: Iterator[tuple], schema: T.StructType, size: int) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(column, f.type) for column, f in zip(zip(*held), arrow)]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def _with_keys(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(order key, conversation, place, turn key, role, text) of turns in order."""
    current: object = object()
    chain, place = b"", 0
    head: list[tuple] = []
    order: bytes | None = None

    def flush():
        key = b"".join(row[2][:8] for row in head)
        return key, [(key, *row) for row in head]

    for number, role, text in rows:
        if number != current:
            if order is None:
                yield from flush()[1]
            current, chain, place, head, order = number, b"", 0, [], None
        signed = role.encode("utf-8", "replace"), text.encode("utf-8", "replace")
        chain = xxhash.xxh3_128_digest(chain + b"%d " % len(signed[0]) + b"".join(signed))
        row = (number, place, chain, role, text)
        place += 1
        if order is not None:
            yield (order, *row)
            continue
        head.append(row)
        if len(head) == KEY_TURNS:
            order, out = flush()
            yield from out
    if order is None:
        yield from flush()[1]


# Packs ------------------------------------------------------------------------------


@dataclass
class Pack:
    """One row of text: nodes in depth-first order, and the conversations' last nodes."""

    text: list[str] = field(default_factory=list)
    size: int = 0
    #: What the first conversation takes; the next ones may share all of it.
    opened: int = 0
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    position: list[int] = field(default_factory=list)
    loss_start: list[int] = field(default_factory=list)
    loss_end: list[int] = field(default_factory=list)
    attends: list[list[tuple[int, int]]] = field(default_factory=list)
    conversation: list[object] = field(default_factory=list)
    last_node: list[int] = field(default_factory=list)

    def add(self, parent: int, role: str, text: str) -> int:
        """A new node under ``parent`` (-1: a root)."""
        formatted, first, after = format_turn(role, text)
        at = self.size
        self.text.append(formatted)
        self.size += len(formatted)
        self.start.append(at)
        self.end.append(self.size)
        self.parent.append(parent)
        learns = role == "assistant"
        self.loss_start.append(at + first if learns else at)
        self.loss_end.append(at + after if learns else at)
        if parent < 0:
            self.position.append(0)
            self.attends.append([])
        else:
            own = self.start[parent], self.end[parent]
            self.position.append(self.position[parent] + own[1] - own[0])
            seen = self.attends[parent]
            if seen and seen[-1][1] == own[0]:
                seen = [*seen[:-1], (seen[-1][0], own[1])]
            else:
                seen = [*seen, own]
            self.attends.append(seen)
        return len(self.start) - 1

    def row(self, number: int) -> tuple:
        spans = [[{"start": a, "end": b} for a, b in seen] for seen in self.attends]
        return (number, "".join(self.text), self.start, self.end, self.parent, self.position,
                self.loss_start, self.loss_end, spans, self.conversation, self.last_node)


def pack_schema(conversation: T.DataType) -> T.StructType:
    span = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())
    schema = T.StructType().add("pack_id", "long").add("text", "string")
    for name in ("start", "end", "parent", "position", "loss_start", "loss_end"):
        schema = schema.add(f"node_{name}", T.ArrayType(T.IntegerType()))
    schema = schema.add("node_attends", T.ArrayType(T.ArrayType(span)))
    schema = schema.add("conversations", T.ArrayType(conversation))
    return schema.add("last_nodes", T.ArrayType(T.IntegerType()))


def packs_of(rows: Iterator[tuple]) -> Iterator[Pack]:
    """Packs of turns sorted by order key, conversation and place."""
    pack = Pack()
    path: list[tuple[bytes, int]] = []  # keys and nodes of the path laid out last
    shared, node = True, -1
    for _, number, place, key, role, text in rows:
        if place == 0:
            if node >= 0:
                pack.last_node[-1] = node
            if len(pack.conversation) == 1:
                pack.opened = pack.size
            added = pack.size - pack.opened
            if added >= PACK_CHARS or len(pack.conversation) >= PACK_CONVERSATIONS:
                yield pack
                pack, path = Pack(), []
            shared, node = True, -1
            pack.conversation.append(number)
            pack.last_node.append(-1)
        shared = shared and place < len(path) and path[place][0] == key
        if shared:
            node = path[place][1]
        else:
            node = pack.add(node, role, text)
            del path[place:]
            path.append((key, node))
    if node >= 0:
        pack.last_node[-1] = node
        yield pack


def pack_conversations(conversations: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row per pack, see :func:`pack_schema`; columns turn, role and text are read.

    Turns are ordered by turn, then role and text, missing ones first; a missing role or
    text is empty; rows without a conversation's id are one conversation; repeated rows are
    turns of their own; other columns are left out; an empty table gives no pack. A long
    conversation is never cut: a pack is as long as its last conversation makes it.
    """
    id_type = conversations.schema[conv_id].dataType
    keyed = (
        T.StructType().add("order", "binary").add("conv", id_type).add("place", "long")
        .add("key", "binary").add("role", "string").add("text", "string")
    )
    turns = conversations.select(
        F.col(conv_id).alias("conv"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    by_conversation = (
        turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
        .select("conv", "role", "text")
        .mapInArrow(lambda batches: _batches(_with_keys(_rows(batches)), keyed, 256), keyed)
    )
    by_start = by_conversation.repartitionByRange("order", "conv").sortWithinPartitions(
        "order", "conv", "place"
    )
    packed = pack_schema(id_type)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        made = (pack.row(first + i) for i, pack in enumerate(packs_of(_rows(batches))))
        return _batches(made, packed, 16)

    return by_start.mapInArrow(build, packed)


# Reading back -------------------------------------------------------------------------


def path_text(pack: dict, node: int) -> str:
    """The formatted conversation that ends in a node: what it attends to, then its own."""
    spans = [(span["start"], span["end"]) for span in pack["node_attends"][node]]
    spans.append((pack["node_start"][node], pack["node_end"][node]))
    return "".join([pack["text"][a:b] for a, b in spans])


def loss_text(pack: dict, node: int) -> str:
    """All text under the loss mask on the path to a node, unescaped."""
    parts = []
    while node >= 0:
        parts.append(pack["text"][pack["node_loss_start"][node] : pack["node_loss_end"][node]])
        node = pack["node_parent"][node]
    return "".join([unescape(part) for part in reversed(parts)])


_DIGESTS = (
    T.StructType().add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long")
    .add("loss_sha256", "string").add("formatted_chars", "long")
)


def _digests_of(pack: dict, node: int) -> dict:
    formatted, learnt = path_text(pack, node), loss_text(pack, node)
    turns = parse(formatted)
    read = hashlib.sha256()
    for role, text in turns:
        read.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
    return {
        "n_turns": len(turns),
        "turns_sha256": read.hexdigest(),
        "loss_chars": len(learnt),
        "loss_sha256": hashlib.sha256(learnt.encode("utf-8", "replace")).hexdigest(),
        "formatted_chars": len(formatted),
    }


def read_back(packs: DataFrame) -> DataFrame:
    """Per conversation what its pack holds of it: conv_id and digests."""
    id_type = packs.schema["conversations"].dataType.elementType
    one = T.StructType([T.StructField("conv_id", id_type), *_DIGESTS.fields])
    schema = T.StructType().add("read", T.ArrayType(one))

    def work(columns: dict[str, list]) -> dict[str, list]:
        out = []
        for values in zip(*columns.values()):
            pack = dict(zip(columns, values))
            known: dict[int, dict] = {}  # equal conversations end in one node
            read = []
            for number, node in zip(pack["conversations"], pack["last_nodes"]):
                if node not in known:
                    known[node] = _digests_of(pack, node)
                read.append({"conv_id": number, **known[node]})
            out.append(read)
        return {"read": out}

    # A pack's conversations are bounded by PACK_CONVERSATIONS.
    return map_batches(packs, lambda: work, schema).select(F.inline("read"))
