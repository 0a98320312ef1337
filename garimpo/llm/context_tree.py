"""Language-model scores by context-tree weighting over bytes, beside a word-count base.

A text is the sequence of its lower-cased words, each ended by a blank, and an end mark.
The model codes its bytes, each as eight binary choices, most significant first. The context
of a byte is the RUNNING_DEPTH bytes before it in the text, whatever words they belong to.
For every choice there is a tree of contexts: a node counts the zeros and ones that followed
its context in training and gives the Krichevsky-Trofimov estimate; the weight of a node
against the deeper ones is the posterior that half of the prior mass on each leads to. A
probability mixes the estimates of all depths on the path of its context by these weights;
where the path ends for want of training, the rest of the mass says one half.

As Spark jobs: a task turns its documents into blocks of bounded bytes, each a few cells that
are worked on one by one. A block's n-grams (a byte and its context) are counted before the
shuffle and dealt into parts by their last two context bytes; a part sums them over all blocks
and builds the trees below depth 2, a choice of the byte and some pairs of last bytes at a
time. The trees above are sums over parts, 255 choices times 256 contexts at most. Scores flow
back to the blocks, where a text is the sum over its n-grams. Words of the base go the same
way, by shards. The number of parts and shards follows the size of the corpus. A pair of last
bytes stays in one part: what it holds there are its distinct n-grams, as rows of whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from garimpo.llm.common import ROWS_AT_ONCE, as_bytes, doc_crc, stored, words

#: Bytes of context, at most 6: in any order an n-gram must fit into a long.
RUNNING_DEPTH = 6
#: Text bytes of a cell of documents, and of the corpus to one part of n-grams.
STRETCH_BYTES = 4 << 20
PART_BYTES = 24 << 20
#: Texts, and bytes of them, whose n-grams are worked out at once. A text's place among these
#: texts takes a byte beside its n-gram; longer texts are worked out piece by piece.
TEXTS_AT_ONCE = 256
BYTES_AT_ONCE = 1 << 20
#: N-grams whose trees are worked out at once, unless one pair of last bytes has more.
GRAMS_AT_ONCE = 400_000
#: Text bytes of a block of documents, and of the corpus to one shard of words, about.
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 96 << 20
#: Added to every count of the base model.
BASE_ADD = 0.1

_BLANK, _BEYOND = 0x20, 0x0A  # neither occurs in a word
_END = b"\n"  # the end of a text as a token
_LOG_HALF = math.log(0.5)


# Byte n-grams -------------------------------------------------------------------------


def gram_runs(
    tokens: list[bytes], depth: int = RUNNING_DEPTH, most: int | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-gram of every byte of the tokens and of their ends, and its token's place.

    An n-gram is a whole number: the byte in the lowest eight bits, above it the context,
    nearest byte first. Beyond the blank before the word the context is filled up. About
    ``most`` n-grams come at once, whatever the length of a token.
    """
    fill = bytes([_BEYOND]) * (depth - 1) + b" "
    # Read as a number, the eight bytes that end at a byte are its n-gram and more above.
    line = b"\n" * 7 + fill + (b" " + fill).join(tokens) + b" " + b"\n" * 8
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + depth + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    size = int(ends[-1]) if tokens else 0
    for low in range(0, size, most or max(1, size)):
        high = min(size, low + (most or size))
        grams = np.empty(-(-(high - low) // 8) * 8, np.int64)
        for i in range(8):
            each = np.frombuffer(line, ">i8", (min(len(line), high + 15) - low - i) // 8, low + i)
            grams[i::8] = each[: len(grams) // 8]
        grams = grams[: high - low] & ((1 << (8 * depth + 8)) - 1)
        first, last = np.searchsorted(ends, (low, high - 1), "right")
        there = slice(first, last + 1)
        parts = np.minimum(ends[there], high) - np.maximum(starts[there], low)
        owner = np.repeat(np.arange(first, last + 1), parts)
        filled = (starts[there, None] + np.arange(depth)).ravel()
        own = np.ones(len(grams), bool)
        own[filled[(filled >= low) & (filled < high)] - low] = False
        yield grams[own], owner[own]


def byte_grams(tokens: list[bytes], depth: int = RUNNING_DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all tokens at once, see :func:`gram_runs`."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64)
    return next(gram_runs(tokens, depth), empty)


def _starts(numbers: np.ndarray) -> np.ndarray:
    """Where each distinct value begins, in order."""
    if not len(numbers):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(numbers[1:] != numbers[:-1]) + 1])


#: N-grams and counts as one number, for sorts of plain numbers: an n-gram takes 56 bits of 63.
_COUNT_BITS = 7
_MOST = (1 << _COUNT_BITS) - 1


def _with_counts(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers of an n-gram and a count up to ``_MOST``; larger counts take several numbers."""
    whole, rest = np.divmod(counts, _MOST)
    grams = grams << _COUNT_BITS
    return np.concatenate([grams | rest, np.repeat(grams | _MOST, whole)])


def _counted(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and the sums of their counts."""
    both = np.concatenate([np.zeros(0, np.int64), *numbers])
    numbers.clear()
    both.sort()
    counts = both & _MOST
    both >>= _COUNT_BITS
    at = _starts(both)
    return both[at], (np.add.reduceat(counts, at) if len(at) else counts)


def _merged(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for whole numbers, of a few sorted runs of keys behind each other."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], (np.add.reduceat(values[order], first) if len(first) else values[:0])


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of the values of each."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, *(np.bincount(place, v, len(distinct)).astype(float) for v in values)


# Trees ------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after seven steps up."""
    steps = np.zeros_like(x)
    for i in range(7):
        steps += np.log(x + i)
    y = x + 7
    tail = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - steps


#: Counts whose log gammas are kept; most nodes have few.
_KEPT_COUNTS = 1 << 14
_HALF_GAMMA = _log_gamma(np.arange(_KEPT_COUNTS) + 0.5)
_WHOLE_GAMMA = _log_gamma(np.arange(_KEPT_COUNTS) + 1.0)


def _log_gamma_of(counts: np.ndarray, kept: np.ndarray, more: float) -> np.ndarray:
    small = np.minimum(counts, _KEPT_COUNTS - 1).astype(np.int64)
    out = kept[small]
    large = counts >= _KEPT_COUNTS
    if large.any():
        out[large] = _log_gamma(counts[large] + more)
    return out


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives such a sequence."""
    both = _log_gamma_of(zeros, _HALF_GAMMA, 0.5) + _log_gamma_of(ones, _HALF_GAMMA, 0.5)
    return both - _log_gamma_of(zeros + ones, _WHOLE_GAMMA, 1.0) - math.log(math.pi)


def _weighted(zeros, ones, below=None):
    """Log of the weighted probability of nodes, and the weight of their own estimates.

    ``below`` is the sum over the deeper nodes; a deepest node has none. Nodes without
    training have no weight.
    """
    own = log_estimate(zeros, ones)
    if below is None:
        log_all, weight = own, np.ones(len(own))
    else:
        log_all = np.logaddexp(own, below) + _LOG_HALF
        weight = np.exp(own + _LOG_HALF - log_all)
    seen = zeros + ones > 0
    return np.where(seen, log_all, 0.0), np.where(seen, weight, 0.0)


def _nearest_first(grams: np.ndarray, depth: int) -> np.ndarray:
    """The context of each n-gram with its nearest byte highest: nodes are its prefixes."""
    out = np.zeros_like(grams)
    for back in range(depth):
        out = (out << 8) | ((grams >> (8 * back + 8)) & 255)
    return out


class Subtrees:
    """Nodes of depth 2 and more of some n-grams, one choice of the byte at a time.

    In the order of (last two context bytes, choices made before, the other context bytes,
    nearest first) the nodes of every depth are runs of rows, and those of a node lie side
    by side: a choice needs one sort of few distinct values, and sums over runs.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int):
        """``grams`` must be in the order of :func:`_nearest_first`."""
        self.depth = depth
        self.context = _nearest_first(grams, depth)
        self.byte = grams & 255
        self.counts = counts.astype(float)
        pair = self.context >> (8 * (depth - 2))
        self.group = np.cumsum(np.diff(pair, prepend=pair[:1]) != 0)
        self.pairs = (grams >> 8) & 0xFFFF

    def _choice(self, k: int):
        """Rows in order, and by depth the first row, zeros, ones, log and weight of nodes."""
        tree = (1 << k) | (self.byte >> (8 - k))
        key = self.group * 256 + tree
        kind = np.uint16 if len(key) and key[-1] < 1 << 16 else np.int64
        order = np.argsort(key.astype(kind), kind="stable")
        key, context, n = key[order], self.context[order], self.counts[order]
        bit = (self.byte[order] >> (7 - k)) & 1
        new_key = np.diff(key, prepend=key[:1] - 1) != 0
        levels = {}
        starts = zeros = ones = below = None
        for level in range(self.depth, 1, -1):
            prefix = context >> (8 * (self.depth - level))
            if starts is None:
                starts = np.flatnonzero(new_key | (np.diff(prefix, prepend=prefix[:1]) != 0))
                ones = np.add.reduceat(n * bit, starts)
                zeros = np.add.reduceat(n, starts) - ones
            else:
                at = prefix[starts]
                first = np.flatnonzero(new_key[starts] | (np.diff(at, prepend=at[:1]) != 0))
                zeros, ones = np.add.reduceat(zeros, first), np.add.reduceat(ones, first)
                below = np.add.reduceat(log_all, first)
                starts = starts[first]
            log_all, weight = _weighted(zeros, ones, below)
            levels[level] = (starts, zeros, ones, log_all, weight)
        return order, tree[order], bit, levels

    def second_level(self) -> list[np.ndarray]:
        """Context, tree, zeros, ones and log of the nodes of depth 2."""
        parts = []
        for k in range(8 if len(self.byte) else 0):
            order, tree, _, levels = self._choice(k)
            starts, zeros, ones, log_all, _ = levels[2]
            context = self.pairs[order[starts]] & 255
            parts.append((context, tree[starts], zeros, ones, log_all))
        return [np.concatenate(column) for column in zip(*parts)] or [np.zeros(0)] * 5

    def log_probabilities(self, top_mixed: np.ndarray, top_rest: np.ndarray) -> np.ndarray:
        """Log10 probability of the byte of each n-gram in its context.

        ``top_mixed`` and ``top_rest`` hold, by nearest context byte and tree, what depths 0
        and 1 have mixed of the probability of a one, and the mass left for deeper nodes.
        """
        total = np.zeros(len(self.byte))
        for k in range(8 if len(self.byte) else 0):
            order, tree, bit, levels = self._choice(k)
            starts = levels[2][0]
            nearest = self.pairs[order[starts]] & 255
            mixed, rest = top_mixed[nearest, tree[starts]], top_rest[nearest, tree[starts]]
            above = starts
            for level in range(2, self.depth + 1):
                starts, zeros, ones, _, weight = levels[level]
                parent = np.searchsorted(above, starts, "right") - 1
                mixed, rest = mixed[parent], rest[parent]
                mixed = mixed + rest * weight * (ones + 0.5) / (zeros + ones + 1)
                rest = rest * (1 - weight)
                above = starts
            one = np.repeat(mixed + 0.5 * rest, np.diff(starts, append=len(order)))
            total[order] += np.log10(np.where(bit == 1, one, 1 - one))
        return total


def top_of_trees(context, tree, zeros, ones, log_all) -> tuple[np.ndarray, np.ndarray]:
    """By nearest context byte and tree: what depths 0 and 1 mix, and the mass left over.

    The arguments are the nodes of depth 1, ``log_all`` summed over the deeper ones.
    """
    mixed, rest = np.zeros((256, 256)), np.ones((256, 256))
    if not len(context):
        return mixed, rest
    log_one, weight = _weighted(zeros, ones, log_all)
    roots, root_zeros, root_ones, below = _summed(tree, zeros, ones, log_one)
    _, root_weight = _weighted(root_zeros, root_ones, below)
    mixed[:, roots] = root_weight * (root_ones + 0.5) / (root_zeros + root_ones + 1)
    rest[:, roots] = 1 - root_weight
    at = context, tree
    mixed[at] += rest[at] * weight * (ones + 0.5) / (zeros + ones + 1)
    rest[at] *= 1 - weight
    return mixed, rest


# Blocks and shards --------------------------------------------------------------------

_BLOCKS = "block bigint, shard int, words binary, counts binary, docs binary"


def _squeezed(data: bytes | pa.Buffer) -> bytes:
    return zstandard.compress(data, 3)


def _numbers(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _one(data: bytes) -> pa.Array:
    return pa.array([zstandard.decompress(data)], pa.large_binary())


def _list(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split()


class _Block:
    """Documents and their words, until they are enough for a block.

    Documents lie in cells of about STRETCH_BYTES of text, squeezed once they are full.
    """

    def __init__(self, id_type: pa.DataType):
        self.id_type = id_type
        self.ids: list = []
        self.held_out: list[bool] = []
        self.texts: list[bytes] = []
        self.cells: list[bytes] = []
        self.size = self.open = 0
        self.trained: Counter = Counter()
        self.seen: set[bytes] = set()

    def add(self, number: object, held_out: bool, text: bytes) -> None:
        found = words(text.lower())
        self.ids.append(number)
        self.held_out.append(held_out)
        self.texts.append(b" ".join(found))
        self.size += len(text) + 64
        self.open += len(text) + 64
        if held_out:
            self.seen.update(found)
        else:
            self.trained.update(found)
        if self.open >= STRETCH_BYTES:
            self.close()

    def close(self) -> None:
        """Squeeze the open documents into a cell."""
        docs = pa.table(
            [pa.array(self.ids, self.id_type), pa.array(self.held_out, pa.bool_()),
             pa.array(self.texts, pa.large_binary())],
            names=["doc_id", "held_out", "text"],
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as writer:
            writer.write_table(docs)
        self.cells.append(_squeezed(sink.getvalue()))
        self.ids, self.held_out, self.texts, self.open = [], [], [], 0

    def rows(self, number: int, shards: int) -> Iterator[tuple]:
        if self.ids:
            self.close()
        for cell in self.cells:
            yield number, -1, None, None, cell
        self.cells = []
        counts = dict.fromkeys(self.seen, 0)
        counts.update(self.trained)
        parts: list[list[bytes]] = [[] for _ in range(shards)]
        for word in sorted(counts):
            parts[xxhash.xxh32_intdigest(word) % shards].append(word)
        for shard, part in enumerate(parts):
            n = np.array([counts[word] for word in part], np.int64)
            yield number, shard, _squeezed(b" ".join(part)), _squeezed(n.tobytes()), None


def _make_blocks(id_type: pa.DataType, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block(id_type)

        def done() -> Iterator[pa.RecordBatch]:
            for row in block.rows(number, shards):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([value], kind) for value, kind in
                     zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                    names=["block", "shard", "words", "counts", "docs"],
                )

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                for row in zip(*(column.to_pylist() for column in part.columns)):
                    block.add(*row)
                    if block.size >= BLOCK_BYTES:
                        yield from done()
                        number, block = number + 1, _Block(id_type)
        if block.size:
            yield from done()

    return run


def _vocabulary(shard: pa.Table) -> tuple[list[list[bytes]], dict[bytes, int], np.ndarray]:
    """Words by block, their places in the vocabulary of the shard, and counts."""
    lists = [_list(data) for data in shard["words"].to_pylist()]
    place: dict[bytes, int] = {}
    for part in lists:
        for word in part:
            place.setdefault(word, len(place))
    total = np.zeros(len(place), np.int64)
    for part, counts in zip(lists, shard["counts"].to_pylist()):
        at = np.fromiter(map(place.__getitem__, part), np.int64, len(part))
        total[at] += _numbers(counts, np.int64)
    return lists, place, total


_GRAM_BLOCKS = "block bigint, part int, grams binary, counts binary"
_SCORED = "block bigint, kind string, keys binary, counts binary, scores binary"


def _docs(data: bytes | pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_all()


def _stretches(docs: pa.Table) -> Iterator[tuple[int, list[bytes]]]:
    """Whole texts with their end marks, some at once, and the place of the first."""
    first, texts, size = 0, [], 0
    for place, text in enumerate(docs["text"]):
        plain = text.as_py()
        texts.append(plain + b" " + _END if plain else _END)
        size += len(plain)
        if size >= BYTES_AT_ONCE or len(texts) == TEXTS_AT_ONCE:
            yield first, texts
            first, texts, size = place + 1, [], 0
    if texts:
        yield first, texts


def _words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text of words and single blanks has, and all words in order."""
    parts = pc.split_pattern(texts, " ")
    found = parts.flatten()
    there = pc.greater(pc.binary_length(found), 0)  # an empty text has one word of no bytes
    if not pc.all(there).as_py():
        owner = pc.list_parent_indices(parts).filter(there).to_numpy()
        return np.bincount(owner, minlength=len(parts)), found.filter(there)
    return pc.list_value_length(parts).to_numpy().astype(np.int64), found


def _packed_grams(grams: np.ndarray) -> bytes:
    return _squeezed(np.diff(grams, prepend=0).tobytes())


def _unpacked_grams(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, np.int64))


def _grams_of_blocks(depth: int, parts: int):
    """N-grams of blocks and their counts in training texts, one row for each part."""

    def counted(docs: pa.Table) -> Iterator[np.ndarray]:
        trained = ~np.array(docs["held_out"].to_pylist(), bool)
        for first, texts in _stretches(docs):
            for some, owner in gram_runs(texts, depth, BYTES_AT_ONCE):
                # The lowest bit says whether a training text has it.
                marked = (some << 1) | trained[first + owner]
                marked.sort()
                some = marked >> 1
                at = _starts(some)
                yield _with_counts(some[at], np.add.reduceat(marked & 1, at))

    def rows(number: int, numbers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        grams, counts = _counted(numbers)
        part = ((grams >> 8) & 0xFFFF) * 40503 % 65521 % parts
        for p in range(parts):
            at = part == p
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.array([p], pa.int32()),
                    pa.array([_packed_grams(grams[at])], pa.binary()),
                    pa.array([_squeezed(counts[at].tobytes())], pa.binary()),
                ],
                names=["block", "part", "grams", "counts"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block's cells follow each other; of one that two tasks read, each tells its own.
        block, numbers = None, []
        for batch in batches:
            for number, data in zip(batch["block"], batch["docs"]):
                if number.as_py() != block:
                    if numbers:
                        yield from rows(block, numbers)
                    block, numbers = number.as_py(), []
                numbers.extend(counted(_docs(data.as_buffer())))
        if numbers:
            yield from rows(block, numbers)

    return run


def _of_part(part: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams, nearest context byte first, and their counts over all blocks."""
    grams, n = _merged(
        np.concatenate([_unpacked_grams(data) for data in part["grams"].to_pylist()]),
        np.concatenate([_numbers(data, np.int64) for data in part["counts"].to_pylist()]),
    )
    order = np.argsort((_nearest_first(grams, depth) << 8) | (grams & 255))
    return grams[order], n[order]


def _subtrees(grams: np.ndarray, n: np.ndarray, depth: int) -> Iterator[Subtrees]:
    """Subtrees of whole pairs of last bytes, some at once. One pair is never split."""
    pair = (grams >> 8) & 0xFFFF
    edges = [*np.flatnonzero(np.diff(pair, prepend=-1)).tolist(), len(grams)]
    start = 0
    for this, following in zip(edges[1:], [*edges[2:], None]):
        if following is None or following - start > GRAMS_AT_ONCE:
            yield Subtrees(grams[start:this], n[start:this], depth)
            start = this


def _second_level_of_part(depth: int):
    def work(part: pa.Table) -> pa.Table:
        nodes = [trees.second_level() for trees in _subtrees(*_of_part(part, depth), depth)]
        context, tree, zeros, ones, log_all = (
            [np.concatenate(column) for column in zip(*nodes)] if nodes else [np.zeros(0)] * 5
        )
        keys = (context.astype(np.int64) << 8) | tree.astype(np.int64)
        keys, zeros, ones, log_all = _summed(keys, zeros, ones, log_all)
        return pa.table(
            {"context": keys >> 8, "tree": keys & 255, "zeros": zeros, "ones": ones,
             "log_all": log_all}
        )

    return work


def _scores_of_part(depth: int, mixed: np.ndarray, rest: np.ndarray):
    def work(part: pa.Table) -> pa.Table:
        grams, n = _of_part(part, depth)
        scores = [t.log_probabilities(mixed, rest) for t in _subtrees(grams, n, depth)]
        log10 = np.concatenate([np.zeros(0), *scores]).astype(np.float32)
        order = np.argsort(grams)
        grams, log10 = grams[order], log10[order]
        back = [
            _squeezed(log10[np.searchsorted(grams, _unpacked_grams(data))].tobytes())
            for data in part["grams"].to_pylist()
        ]
        rows = part.num_rows
        return pa.table(
            {
                "block": part["block"], "kind": ["gram"] * rows, "keys": part["grams"],
                "counts": pa.nulls(rows, pa.binary()), "scores": pa.array(back, pa.binary()),
            }
        )

    return work


def _counts_of_words(shard: pa.Table) -> pa.Table:
    """Counts over all blocks of each block's words; those of the shard ride on its first."""
    lists, place, total = _vocabulary(shard)
    back = []
    for part in lists:
        at = np.fromiter(map(place.__getitem__, part), np.int64, len(part))
        back.append(_squeezed(total[at].tobytes()))
    more = [0] * (len(lists) - 1)
    return pa.table(
        {
            "block": shard["block"], "keys": shard["words"],
            "counts": pa.array(back, pa.binary()),
            "n": pa.array([int(total.sum()), *more], pa.int64()),
            "known": pa.array([int((total > 0).sum()), *more], pa.int64()),
        }
    )


def _running_scores_of_docs(depth: int, train_tokens: int, known_words: int, ends: int):
    scale = train_tokens + BASE_ADD * (known_words + 1)

    def score_of(texts: list[bytes], grams: np.ndarray, log10: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(texts))
        for some, owner in gram_runs(texts, depth, BYTES_AT_ONCE):
            # N-gram and text as one number: a sort of plain numbers, one search a n-gram.
            both = (some.view(np.uint64) << np.uint64(8)) | owner.view(np.uint64)
            both.sort()
            some = (both >> np.uint64(8)).view(np.int64)
            at = _starts(some)
            each = np.repeat(log10[np.searchsorted(grams, some[at])], np.diff(at, append=len(some)))
            sums += np.bincount((both & np.uint64(255)).view(np.int64), each, len(texts))
        return sums

    def work(block: pa.Table, scored: pa.Table) -> pa.Table:
        vocabulary, counts = [], []
        known, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for row in scored.to_pylist():
            if row["kind"] == "gram":
                known.append(_unpacked_grams(row["keys"]))
                scores.append(_numbers(row["scores"], np.float32))
            else:
                vocabulary.append(_words_of(_one(row["keys"]))[1])
                counts.append(_numbers(row["counts"], np.int64))
        grams, log10 = np.concatenate(known), np.concatenate(scores)
        order = np.argsort(grams)
        grams, log10 = grams[order], log10[order].astype(float)
        vocabulary = pa.concat_arrays([pa.array([], pa.large_binary()), *vocabulary])
        n = np.concatenate([np.zeros(0, np.int64), *counts])
        base = np.log10((n + BASE_ADD) / scale)
        base_end = math.log10((ends + BASE_ADD) / scale)
        outs = []
        for data in block["docs"]:
            docs = _docs(data.as_buffer())
            rows = docs.num_rows
            sizes, found = _words_of(docs["text"].combine_chunks())
            at = pc.index_in(found, value_set=vocabulary).to_numpy()
            owner = np.repeat(np.arange(rows), sizes)
            known_tokens = np.bincount(owner[n[at] > 0], minlength=rows) + int(ends > 0)
            sums = [score_of(texts, grams, log10) for _, texts in _stretches(docs)]
            outs.append(
                pa.table(
                    {
                        "doc_id": docs["doc_id"],
                        "held_out": docs["held_out"],
                        "n_tokens": pa.array(sizes + 1, pa.int64()),
                        "n_known": pa.array(known_tokens, pa.int64()),
                        "train_tokens": pa.array([train_tokens] * rows, pa.int64()),
                        "base_score": pa.array(np.bincount(owner, base[at], rows) + base_end),
                        "score": pa.array(np.concatenate(sums), pa.float64()),
                    }
                )
            )
        return pa.concat_tables(outs)

    return work


# On tables --------------------------------------------------------------------------


def _blocks(docs: DataFrame, text: str):
    """Stored blocks with their words, the size of the corpus, the type of ids."""
    held_out = F.coalesce(doc_crc() % 10 == 0, F.lit(True))
    read = docs.select("doc_id", held_out.alias("held_out"), as_bytes(text).alias("_bytes"))
    size = read.agg(
        F.coalesce(F.sum(F.octet_length("_bytes") + 64), F.lit(0)).alias("bytes"),
        F.count_if(~F.col("held_out")).alias("ends"),
    ).first()
    shards = max(1, -(-size.bytes // SHARD_BYTES))
    schema = read.schema["doc_id"].dataType
    blocks = read.mapInArrow(_make_blocks(to_arrow_type(schema), shards), _BLOCKS)
    return stored(blocks, "blocks"), size, schema


def score_running(docs: DataFrame, depth: int = RUNNING_DEPTH, text: str = "text") -> DataFrame:
    """Both models' log10 probability of every text, learnt from those not held out.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A missing
    or empty text is its end alone; a row without id is held out; equal rows score alike,
    and teach as often as they are there; other columns are left out; an empty table gives
    an empty one. Code length per byte is ``-score / log10(2)`` over the bytes of the words
    and one more for each token.
    """
    blocks, size, schema = _blocks(docs, text)
    of_docs = blocks.where("shard < 0").select("block", "docs")
    of_words = blocks.where("shard >= 0").select("block", "shard", "words", "counts")
    counted = stored(
        of_words.groupBy("shard").applyInArrow(
            _counts_of_words, "block bigint, keys binary, counts binary, n bigint, known bigint"
        ),
        "word-counts",
    )
    totals = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("known")
    ).first()
    parts = max(1, -(-size.bytes // PART_BYTES))
    grams = stored(
        of_docs.mapInArrow(_grams_of_blocks(depth, parts), _GRAM_BLOCKS),
        "gram-blocks",
    )
    top = (
        grams.groupBy("part")
        .applyInArrow(
            _second_level_of_part(depth),
            "context bigint, tree bigint, zeros double, ones double, log_all double",
        )
        .groupBy("context", "tree")
        .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"),
             F.sum("log_all").alias("log_all"))
        .orderBy("context", "tree")
        .toPandas()
    )
    mixed, rest = top_of_trees(*(top[name].to_numpy() for name in top.columns))
    of_grams = grams.groupBy("part").applyInArrow(_scores_of_part(depth, mixed, rest), _SCORED)
    base = counted.select(
        "block", F.lit("word").alias("kind"), "keys", "counts",
        F.lit(None).cast("binary").alias("scores"),
    )
    return (
        of_docs.groupBy("block")
        .cogroup(of_grams.unionAll(base).groupBy("block"))
        .applyInArrow(
            _running_scores_of_docs(
                depth, totals.n + size.ends, totals.known + int(size.ends > 0), size.ends
            ),
            f"doc_id {schema.simpleString()}, held_out boolean, n_tokens bigint, "
            "n_known bigint, train_tokens bigint, base_score double, score double",
        )
    )
