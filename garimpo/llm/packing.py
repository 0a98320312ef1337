"""Packing documents into windows by the sum-of-squares rule.

A document's ids fill whole windows as long as they can; the rest, shorter than a window,
is an item. The rule keeps one array: how many open windows stand at each fill level. An
item goes where the sum of the squared counts afterwards is least, into an open window of
some level or into a new one; of equal choices, into the fullest. So no level collects
many windows that no item completes.

Every task packs its own part of the table in the order of its rows, in one pass, with
one level array and the ids of its open windows. When its rows end, what lies in windows
still open is cut anew: strung together into whole windows, the remainder into windows as
long as the powers of two that it is the sum of. So no window needs padding: each is full,
or a power of two long. Only documents in windows open at the end of a task are cut for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.llm import bpe
from garimpo.llm.common import ROWS_AT_ONCE

WINDOW = 4096
#: Ends every document.
END_ID = 2

#: (document, place of its first id, ids, ids of the document) of one piece.
Piece = tuple[object, int, np.ndarray, int]


class LevelArray:
    """Open windows by fill level, and the rule that picks one."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window, np.int64)  # count[0] stays 0: a new window is free
        self.open: dict[int, list[list[Piece]]] = {}

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece away; the window's pieces if that fills it."""
        size, count, window = len(piece[2]), self.count, self.window
        # Change of the sum of squares for level h: the window leaves h (1 - 2 count[h]) and
        # arrives at h + size (1 + 2 count[h + size]); a full window counts no more.
        levels = np.flatnonzero(count[: window - size + 1])
        best = 0
        least = 1 + 2 * count[size]
        if len(levels):
            after = levels + size
            change = 1 - 2 * count[levels]
            partly = after < window
            change[partly] += 1 + 2 * count[after[partly]]
            fullest = len(levels) - 1 - int(np.argmin(change[::-1]))
            if change[fullest] <= least:
                best = int(levels[fullest])
        held: list[Piece] = []
        if best:
            held = self.open[best].pop()
            count[best] -= 1
        held.append(piece)
        level = best + size
        if level == window:
            return held
        count[level] += 1
        self.open.setdefault(level, []).append(held)
        return None

    def rest(self) -> Iterator[Piece]:
        """The pieces of all windows still open, fullest window first."""
        for level in sorted(self.open, reverse=True):
            for held in self.open[level]:
                yield from held


def whole_windows(pieces: Iterator[Piece], window: int) -> Iterator[list[Piece]]:
    """Cut pieces into full windows, and what remains into powers of two."""
    held: list[Piece] = []
    room = window
    for number, start, ids, total in pieces:
        while len(ids):
            held.append((number, start, ids[:room], total))
            taken = len(held[-1][2])
            start, ids, room = start + taken, ids[taken:], room - taken
            if not room:
                yield held
                held, room = [], window
    left = window - room
    if not left:
        return
    lengths = [1 << bit for bit in range(left.bit_length() - 1, -1, -1) if left >> bit & 1]
    for length in lengths:
        part: list[Piece] = []
        while length:
            number, start, ids, total = held.pop(0)
            part.append((number, start, ids[:length], total))
            if len(ids) > length:
                held.insert(0, (number, start + length, ids[length:], total))
            length -= len(part[-1][2])
        yield part


def pack(
    documents: Iterator[tuple[object, np.ndarray]], window: int = WINDOW
) -> Iterator[list[Piece]]:
    """Windows of the given (number, ids) documents; every id lies in one piece."""
    levels = LevelArray(window)
    for number, ids in documents:
        total = len(ids)
        whole = total - total % window
        for start in range(0, whole, window):
            yield [(number, start, ids[start : start + window], total)]
        # Own memory: an open window must not keep a long document alive.
        if total > whole:
            full = levels.place((number, whole, ids[whole:].copy(), total))
            if full:
                yield full
    yield from whole_windows(levels.rest(), window)


def _schema(doc_id: T.DataType, with_ids: bool) -> T.StructType:
    schema = T.StructType().add("doc_id", doc_id).add("start", "long").add("length", "long")
    schema = schema.add("ids_crc32", "long").add("doc_tokens", "long")
    schema = schema.add("sequence_id", "long").add("offset", "long")
    return schema.add("ids", T.ArrayType(T.LongType())) if with_ids else schema


def pack_documents(
    docs: DataFrame,
    path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
    forget: bool = False,
) -> DataFrame:
    """One row per piece: where its ids stand in its document and in its sequence.

    ``sequence_id`` is the task's number and a running number; ``offset`` has no gaps from
    0 within a sequence. A missing or empty text is one document of the end id alone; a
    missing id stays missing; equal rows are packed one by one; other columns are left out;
    an empty table gives no sequence. ``ids`` are the piece's own ids. With ``forget`` a
    task empties the worker's tables of words at its end: steps of other kinds that follow
    in the same workers have that memory.
    """
    schema = _schema(docs.schema[doc_id].dataType, with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        vocabulary = bpe.load(path)
        end = np.array([end_id], "<u4").tobytes()

        def documents():
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(at, ROWS_AT_ONCE)
                    numbers = part.column(0).to_pylist()
                    for number, value in zip(numbers, part.column(1).to_pylist()):
                        yield number, np.frombuffer(vocabulary.encode(value or "") + end, "<u4")

        sequence = TaskContext.get().partitionId() << 33
        rows: list[list] = [[] for _ in schema]
        weight = 0
        for pieces in pack(documents(), window):
            offset = 0
            for number, start, ids, total in pieces:
                values = [number, start, len(ids), zlib.crc32(ids.tobytes()), total]
                values += [sequence, offset, ids.astype(np.int64)][: 2 + with_ids]
                for column, value in zip(rows, values):
                    column.append(value)
                offset += len(ids)
            sequence += 1
            weight += window if with_ids else len(pieces)
            if weight > 1 << 16:
                yield _batch(rows, arrow)
                rows, weight = [[] for _ in schema], 0
        if rows[0]:
            yield _batch(rows, arrow)
        if forget:
            vocabulary.forget()

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def _batch(rows: list[list], arrow: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, type=field.type) for values, field in zip(rows, arrow)]
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


