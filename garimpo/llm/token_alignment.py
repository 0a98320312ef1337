"""Aligning the tokens of two tokenizers over the same texts, by their spans.

Tokenizer A is a byte-level vocabulary of the tokenizers library, B a sentencepiece model.
Each reports where its tokens stand: A as character offsets, B as the byte spans of its
protocol message. These are the coarse ends of the tokens. A character of several bytes may
be shared by several tokens of A, and B spells unknown characters byte by byte, with spans
only at the last one; inside such characters the ends come from the tokens' own bytes. Ends
that both share cut the tokens into groups; between two neighbouring ends of either lies
one link, an A token and a B token that share these bytes.

Both tokenizers begin anew at a blank or line break between two other characters, if no
token of B spans it (looked up in its vocabulary; A's pattern never does). So a text is a
sequence of chunks that are tokenized alike wherever they stand, and the groups and links of
a text are those of its chunks. Distinct chunks of a block of documents are strung together
and tokenized at once.

As Spark jobs: a task turns its documents into blocks of bounded size. A block is one row
that holds the id pairs of its links, with how often they occur, and which of them each of
its chunks has; each document is a row with the numbers of its chunks. Pairs are summed over
all blocks in a grouped aggregation, the best count of each B id is taken (one row per id of
the vocabulary), and both go back to the blocks that hold the pair, where the documents are
added up.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.llm.bpe import byte_letters
from garimpo.llm.common import ROWS_AT_ONCE, stored

#: Characters of text after which a block is closed; a longer text is a block of its own.
BLOCK_CHARS = 32_000_000
#: Chunks beyond which a Python worker starts a new table of them at the next block.
KEPT_CHUNKS = 800_000
#: Characters of chunks that are tokenized at once.
AT_ONCE = 100_000

# Where a text may be cut: a single blank or line break between two other characters.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_UNEVEN = re.compile(r"\s(?:\s|\Z)")
_PIECE_BLANK = "▁"


@dataclass
class Aligned:
    """Tokens of a stretch of text, and where both cut it; offsets count its bytes."""

    a_ids: np.ndarray
    a_ends: np.ndarray
    b_ids: np.ndarray
    b_ends: np.ndarray


class Tokenizers:
    """Both vocabularies with the bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)

        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        names = self.a.get_vocab(with_added_tokens=False)
        tokens_a = [b""] * (max(names.values()) + 1)
        for name, number in names.items():
            tokens_a[number] = bytes(map(byte_of.__getitem__, name))
        self.bytes_a = tokens_a
        self.length_a = np.array([len(token) for token in tokens_a], np.int64)

        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.single_byte = np.array([self.b.is_byte(i) for i in range(size)])
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if single
            else piece.replace(_PIECE_BLANK, " ").encode()
            for piece, single in zip(pieces, self.single_byte)
        ]
        self.length_b = np.array([len(token) for token in self.bytes_b], np.int64)
        self.size_b = size
        #: The least kind of whole number that holds a pair of ids.
        self.pair_kind = np.min_scalar_type(-len(tokens_a) * size)
        self._names: np.ndarray | None = None
        #: Whether texts may be cut at all; else each is one chunk.
        self.cuts = self._pattern_cuts(path_a) and not any(
            "\n" in piece or _PIECE_BLANK in piece.lstrip(_PIECE_BLANK) for piece in pieces
        )

    @staticmethod
    def _pattern_cuts(path: str) -> bool:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"] or {}
        return (
            spec["normalizer"] is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
        )

    def names_with_marks(self) -> np.ndarray:
        """Every id in decimal with each of the four marks that may stand behind it."""
        if self._names is None:
            every = range(max(len(self.length_a), self.size_b))
            self._names = np.array([[f"{i}{mark}" for mark in ",|;\n"] for i in every], object)
        return self._names

    def align(self, text: str) -> Aligned | None:
        """Tokens of ``text``, which starts with a blank; None if either loses bytes."""
        raw = text.encode()
        encoding = self.a.encode(text, add_special_tokens=False)
        a_ids = np.array(encoding.ids, np.int64)
        offsets = np.fromiter(chain.from_iterable(encoding.offsets), np.int64).reshape(-1, 2)
        spans = self.b.encode(text[1:], return_type="proto").pieces
        b_ids, b_spans = np.fromiter(
            chain.from_iterable([(p.id, p.end) for p in spans]), np.int64
        ).reshape(-1, 2).T
        if b"".join(map(self.bytes_a.__getitem__, a_ids)) != raw:
            return None
        if b"".join(map(self.bytes_b.__getitem__, b_ids)) != raw:
            return None

        # A: characters to bytes; tokens that share their last character with the next
        # one end inside it.
        coarse = offsets[:, 1]
        inside = np.zeros(len(a_ids), bool)
        if len(raw) > len(text):
            width = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            width = 1 + (width > 0x7F).astype(np.int64) + (width > 0x7FF) + (width > 0xFFFF)
            coarse = np.concatenate([[0], np.cumsum(width)])[coarse]
            inside[:-1] = offsets[1:, 0] < offsets[:-1, 1]
        a_ends = _refined(coarse, inside, self.length_a[a_ids])
        # B: spans leave the blank in front out; byte tokens may stand inside a character.
        b_ends = _refined(b_spans + 1, self.single_byte[b_ids], self.length_b[b_ids])
        return Aligned(a_ids, a_ends, b_ids, b_ends)


def _refined(coarse: np.ndarray, inside: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Coarse ends, but inside characters the last sure end and the bytes since."""
    if not inside.any():
        return coarse
    written = np.cumsum(length)
    sure = np.where(inside, -1, np.arange(len(coarse)))
    last = np.maximum.accumulate(sure)
    base = np.where(last < 0, 0, coarse[last] - written[last])
    return np.where(inside, base + written, coarse)


@functools.cache
def load(path_a: str, path_b: str) -> Tokenizers:
    """One pair of vocabularies per Python worker; a worker is one thread already."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizers(path_a, path_b)


_KEPT: dict[tuple[str, str], Chunks] = {}


def kept_chunks(path_a: str, path_b: str) -> Chunks:
    """The worker's table of chunks, which outlives a task; a full one starts anew."""
    chunks = _KEPT.get((path_a, path_b))
    if chunks is None or len(chunks.number) > KEPT_CHUNKS:
        chunks = _KEPT[path_a, path_b] = Chunks()
    return chunks


def split_chunks(text: str, cuts: bool = True) -> list[str]:
    """Chunks of a text as keys: the chunk without its blank in front, unless that would
    be taken for another chunk. :func:`chunk_text` undoes it."""
    if not cuts:
        return [" " + text]
    whole = " " + text
    if not _UNEVEN.search(whole):
        return whole.replace("\n", " \n").split(" ")[1:]
    return [
        part[1:] if part[0] == " " and not part[1:2].isspace() and len(part) > 1 else part
        for part in _CUT.split(whole)
    ]


def chunk_text(key: str) -> str:
    return key if key[0] in " \n" else " " + key


class Chunks:
    """What is known of chunks by their numbers: counts, groups as text, pairs of links."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        #: n_a, n_b, n_groups, pairs; -1 pairs where a tokenizer loses bytes.
        self.counts = np.zeros((0, 4), np.int32)
        self.starts = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int32)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: list[str], counts: np.ndarray, groups: list[str], pairs: np.ndarray):
        self.number.update(zip(keys, range(len(self.number), len(self.number) + len(keys))))
        self.groups.extend(groups)
        self._new.append((counts, pairs))

    def settle(self) -> None:
        """Lay out what was added behind what was there."""
        if self._new:
            counts, pairs = zip(*self._new)
            self._new = []
            self.counts = np.concatenate([self.counts, *counts], dtype=np.int32)
            kind = np.promote_types(self.pairs.dtype, np.result_type(*pairs))
            self.pairs = np.concatenate([self.pairs, *pairs], dtype=kind)
            sizes = np.maximum(self.counts[:, 3], 0).astype(np.int64)
            self.starts = np.cumsum(sizes) - sizes


_NO_PAIRS = np.zeros(0, np.int32)
_LOST = np.array([[0, 0, 0, -1]])


def _learn(chunks: Chunks, tokenizers: Tokenizers, keys: list[str]) -> None:
    """Tokenize new chunks: those that end in a letter strung together, others alone.

    A stretch that loses bytes is taken apart to find the chunks that do.
    """
    batch: list[str] = []
    size = 0
    for key in keys:
        if key[-1].isspace() or not tokenizers.cuts:
            _learn_joined(chunks, tokenizers, [key])
            continue
        batch.append(key)
        size += len(key)
        if size > AT_ONCE:
            _learn_joined(chunks, tokenizers, batch)
            batch, size = [], 0
    if batch:
        _learn_joined(chunks, tokenizers, batch)
    chunks.settle()


def _learn_joined(chunks: Chunks, tokenizers: Tokenizers, keys: list[str]) -> None:
    # B needs a text that starts with a blank of its own: a chunk in front, dropped below.
    lead = " a" if tokenizers.cuts else ""
    texts = [chunk_text(key) for key in keys]
    got = tokenizers.align(lead + "".join(texts))
    if got is None:
        if len(keys) == 1:
            chunks.add(keys, _LOST, [""], _NO_PAIRS)
            return
        half = len(keys) // 2
        _learn_joined(chunks, tokenizers, keys[:half])
        _learn_joined(chunks, tokenizers, keys[half:])
        return

    edges = np.cumsum([len(lead), *(len(text.encode()) for text in texts)])
    ends = np.sort(np.concatenate([got.a_ends, got.b_ends]), kind="stable")
    twice = ends[1:] == ends[:-1]
    shared = ends[1:][twice]
    ends = ends[np.concatenate([[True], ~twice])]
    of_a = np.searchsorted(got.a_ends, ends)
    of_b = np.searchsorted(got.b_ends, ends)
    pairs = (got.a_ids[of_a] * tokenizers.size_b + got.b_ids[of_b]).astype(tokenizers.pair_kind)
    upto = [np.searchsorted(x, edges, "right") for x in (got.a_ends, got.b_ends, shared, ends)]
    counts = np.diff(np.stack(upto, 1), axis=0)
    groups = _group_texts(tokenizers, got, shared, edges)
    chunks.add(keys, counts, groups, pairs[upto[3][0] : upto[3][-1]])


def _group_texts(
    tokenizers: Tokenizers, got: Aligned, shared: np.ndarray, edges: np.ndarray
) -> list[str]:
    """``a1,a2|b1;a3|b2`` of every chunk: tokens by group, A before B, each with the mark
    that stands behind it."""
    ends = np.concatenate([got.a_ends, got.b_ends])
    side = np.repeat([0, 1], [len(got.a_ends), len(got.b_ends)])
    names = np.concatenate([got.a_ids, got.b_ids])
    group = np.searchsorted(shared, ends)
    order = np.lexsort((ends, side, group))
    order = order[ends[order] > edges[0]]
    group, side = group[order], side[order]
    chunk = np.searchsorted(edges, ends[order])
    mark = np.zeros(len(order), np.int64)  # , | ; and the end of a chunk
    mark[:-1] = np.where(
        chunk[1:] != chunk[:-1], 3,
        np.where(group[1:] != group[:-1], 2, (side[1:] != side[:-1]).astype(np.int64)),
    )
    marked = tokenizers.names_with_marks()[names[order], mark]
    if len(marked):
        marked[-1] = marked[-1][:-1]
    return "".join(marked.tolist()).split("\n")


_RESULT = (
    T.StructType().add("n_a", "long").add("n_b", "long").add("n_groups", "long")
    .add("n_links", "long").add("groups_sha256", "string")
)
#: Rows of documents have the numbers of their chunks in ``chunks``; rows of blocks have the
#: pairs, their counts, and per chunk how many pairs it has and which.
_BLOCK = (
    T.StructType().add("_block", "string").add("chunks", "binary").add("pairs", "binary")
    .add("counts", "binary").add("sizes", "binary").add("places", "binary")
)


def _packed(values: np.ndarray, kind: str) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class _Block:
    """Documents of one block, and the counts of their chunks."""

    def __init__(self, tokenizers: Tokenizers, chunks: Chunks, with_groups: bool):
        self.tokenizers, self.chunks, self.with_groups = tokenizers, chunks, with_groups
        #: Numbers of the chunks used here, how often, and the place of each among them.
        self.used = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)
        self.place = np.zeros(0, np.int64)
        self.chars = 0

    def documents(self, texts: list[str]) -> dict[str, list]:
        chunks = self.chunks
        known = chunks.number
        split = [split_chunks(text, self.tokenizers.cuts) if text else [] for text in texts]
        self.chars += sum(map(len, texts))
        each = dict.fromkeys(chain.from_iterable(split))
        _learn(chunks, self.tokenizers, [key for key in each if key not in known])

        numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64)
        ends = np.cumsum([len(keys) for keys in split])
        starts = ends - np.array([len(keys) for keys in split])
        counts = chunks.counts[numbers].astype(np.int64)
        lost = np.concatenate([[0], np.cumsum(counts[:, 3] < 0)])
        whole = lost[ends] == lost[starts]
        counts = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts, 0)])
        counts = np.where(whole[:, None], counts[ends] - counts[starts], 0)
        local = self._places(numbers[np.repeat(whole, ends - starts)])

        n_a, n_b, n_groups, n_links = counts.T.tolist()
        out: dict[str, list] = {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
            "groups_sha256": [], "chunks": [],
        }
        if self.with_groups:
            out["groups"] = []
        at = 0
        numbers = numbers.tolist()
        for start, end, good in zip(starts.tolist(), ends.tolist(), whole.tolist()):
            size = end - start if good else 0
            groups = ";".join(map(chunks.groups.__getitem__, numbers[start : start + size]))
            out["groups_sha256"].append(sha256(groups.encode()).hexdigest() if size else "")
            out["chunks"].append(_packed(local[at : at + size], "<u4"))
            at += size
            if self.with_groups:
                out["groups"].append(groups)
        return out

    def _places(self, numbers: np.ndarray) -> np.ndarray:
        """Places of chunks in this block, new ones behind the others; counts them too."""
        more = np.full(len(self.chunks.number) - len(self.place), -1)
        self.place = np.concatenate([self.place, more])
        fresh = np.unique(numbers)
        fresh = fresh[self.place[fresh] < 0]
        self.place[fresh] = np.arange(len(self.used), len(self.used) + len(fresh))
        self.used = np.concatenate([self.used, fresh])
        local = self.place[numbers]
        times = np.bincount(local, minlength=len(self.used))
        times[: len(self.times)] += self.times
        self.times = times
        return local

    def row(self) -> dict[str, bytes]:
        chunks = self.chunks
        sizes = chunks.counts[self.used, 3].astype(np.int64)
        ends = np.cumsum(sizes)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        every = chunks.pairs[np.repeat(chunks.starts[self.used], sizes) + inside]
        pairs, places = np.unique(every, return_inverse=True)
        counts = np.bincount(places, np.repeat(self.times, sizes), len(pairs))
        return {
            "pairs": _packed(pairs, "<i8"), "counts": _packed(counts, "<i8"),
            "sizes": _packed(sizes, "<u4"), "places": _packed(places, "<u4"),
        }


def _tokenized(
    docs: DataFrame, path_a: str, path_b: str, text: str, keep: tuple[str, ...],
    with_groups: bool, block_chars: int,
) -> DataFrame:
    """Rows of documents and of blocks, told apart by which binary columns they have."""
    kept = T.StructType([docs.schema[name] for name in keep])
    kept = T.StructType([T.StructField(f"_keep{i}", f.dataType) for i, f in enumerate(kept)])
    result = _RESULT if not with_groups else T.StructType([*_RESULT, T.StructField(
        "groups", T.StringType())])
    out = T.StructType([*kept, *result, *_BLOCK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        tokenizers = load(path_a, path_b)
        task = TaskContext.get().partitionId()
        chunks, block, number = kept_chunks(path_a, path_b), None, 0

        def rows(columns: dict, length: int) -> pa.RecordBatch:
            columns["_block"] = pa.array([f"{task}-{number}"] * length)
            return pa.RecordBatch.from_arrays(
                [
                    columns[f.name] if isinstance(columns.get(f.name), pa.Array)
                    else pa.array(columns.get(f.name, [None] * length), type=f.type)
                    for f in schema
                ],
                schema=schema,
            )

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                if block is None:
                    block = _Block(tokenizers, chunks, with_groups)
                texts = [value or "" for value in part.column("_text").to_pylist()]
                columns = block.documents(texts)
                for i in range(len(keep)):
                    columns[f"_keep{i}"] = part.column(f"_keep{i}")
                yield rows(columns, part.num_rows)
                if block.chars >= block_chars:
                    yield rows({name: [value] for name, value in block.row().items()}, 1)
                    block, number = None, number + 1
                    chunks = kept_chunks(path_a, path_b)
        if block is not None:
            yield rows({name: [value] for name, value in block.row().items()}, 1)

    read = docs.select(
        *[F.col(f"`{name}`").alias(f"_keep{i}") for i, name in enumerate(keep)],
        F.col(f"`{text}`").alias("_text"),
    )
    return read.mapInArrow(run, out)


def _pair_rows(blocks: DataFrame) -> DataFrame:
    """(block, place, pair, n) of every distinct pair of every block."""
    schema = (
        T.StructType().add("_block", "string").add("place", "integer").add("pair", "long")
        .add("n", "long")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, pairs, counts in zip(*batch.columns):
                pairs = _unpacked(pairs.as_py(), "<i8")
                counts = _unpacked(counts.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name.as_py()] * len(pairs), pa.string()),
                        pa.array(np.arange(len(pairs), dtype=np.int32)),
                        pa.array(pairs), pa.array(counts),
                    ],
                    names=schema.names,
                )

    return blocks.select("_block", "pairs", "counts").mapInArrow(run, schema)


def pair_counts(pairs: DataFrame, size_b: int) -> DataFrame:
    """(pair, links, best): how many links hold a pair, and whether no other pair of its
    B id has more. The best counts have one row per id of B's vocabulary at most."""
    b_id = F.col("pair") % size_b
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("links")).withColumn("b_id", b_id)
    most = totals.groupBy("b_id").agg(F.max("links").alias("most"))
    return totals.join(most, "b_id").select(
        "pair", "links", (F.col("links") == F.col("most")).alias("best")
    )


def _add_up(keep_fields: list[T.StructField], result: T.StructType):
    """For one block: documents with ``n_best`` and ``count_sum`` from its pairs' values."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*[f.name for f in keep_fields], *result.names]
        is_block = np.array([x is not None for x in left.column("pairs").to_pylist()])
        block = left.filter(pa.array(is_block))
        docs = left.filter(pa.array(~is_block))
        sizes = _unpacked(block.column("sizes")[0].as_py(), "<u4").astype(np.int64)
        places = _unpacked(block.column("places")[0].as_py(), "<u4")
        here = right.column("place").to_numpy()
        links, best = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
        links[here] = right.column("links").to_numpy()
        best[here] = right.column("best").to_numpy(zero_copy_only=False)
        best_in, sum_in = _per_chunk(best, places, sizes), _per_chunk(links, places, sizes)
        n_best, count_sum = [], []
        for data in docs.column("chunks").to_pylist():
            chunks = _unpacked(data, "<u4")
            n_best.append(int(best_in[chunks].sum()))
            count_sum.append(int(sum_in[chunks].sum()))
        out = docs.select(names)
        out = out.append_column("n_best", pa.array(n_best, pa.int64()))
        return out.append_column("count_sum", pa.array(count_sum, pa.int64()))

    return run


def _per_chunk(values: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values[places])])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def align_documents(
    docs: DataFrame, path_a: str, path_b: str, text: str = "text",
    keep: tuple[str, ...] = ("doc_id",), with_groups: bool = True,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``keep`` columns, counts, digest of groups and, of every row, its links' counts.

    ``n_a``, ``n_b``, ``n_groups``, ``n_links``; ``groups_sha256`` and, with
    ``with_groups``, the ``groups`` themselves (``a1,a2|b1;a3|b2``); ``n_best``, links whose
    pair is the commonest of its B id in all of ``docs``, and ``count_sum``, the links'
    pair counts added up. A missing or empty text, or one that either tokenizer does not
    give back byte for byte, has zeros and empty strings. Equal rows stay equal rows, with
    ids or without; other columns are left out, whatever their names; an empty table gives
    an empty one. Both paths must be readable on every executor.
    """
    rows = stored(
        _tokenized(docs, path_a, path_b, text, keep, with_groups, block_chars), "token-alignment"
    )
    pairs = _pair_rows(rows.where(F.col("pairs").isNotNull()))
    counts = pair_counts(pairs, load(path_a, path_b).size_b)
    back = pairs.drop("n").join(counts, "pair").select("_block", "place", "links", "best")

    keep_fields = [rows.schema[f"_keep{i}"] for i in range(len(keep))]
    result = T.StructType(
        [f for f in rows.schema if f.name in {*_RESULT.names, "groups"}]
    )
    out = T.StructType([*keep_fields, *result]).add("n_best", "long").add("count_sum", "long")
    added = (
        rows.drop("counts").groupBy("_block").cogroup(back.groupBy("_block"))
        .applyInArrow(_add_up(keep_fields, result), out)
    )
    return added.select(
        *[F.col(f"_keep{i}").alias(name) for i, name in enumerate(keep)],
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
        *(["groups"] if with_groups else []),
    )
