"""Context-tree weighting against a plain recursion, and the base against counting."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from garimpo.llm import context_tree as ct
from garimpo.llm import queries

from .conftest import SF


def _contexts(token, depth):
    """(bytes before, nearest first, and byte) of a token and the blank behind it."""
    line = b" " + token + b" "
    for i in range(1, len(line)):
        before = line[:i][::-1][:depth]
        yield before + b"\n" * (depth - len(before)), line[i]


def _plain_scores(train, tokens, depth):
    """log10 probability of each token: trees kept as dicts, mixed by plain recursion."""
    counts = defaultdict(lambda: [0, 0])
    for token, n in train.items():
        for before, byte in _contexts(token, depth):
            prefix = 1
            for k in range(7, -1, -1):
                bit = byte >> k & 1
                for d in range(depth + 1):
                    counts[before[:d], prefix][bit] += n
                prefix = prefix << 1 | bit
    children = defaultdict(set)
    for context, prefix in counts:
        if context:
            children[context[:-1], prefix].add((context, prefix))

    def log_kt(zeros, ones):
        return (math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5)
                - math.lgamma(zeros + ones + 1) - math.log(math.pi))

    weighted = {}

    def log_weighted(node):
        if node not in weighted:
            own = log_kt(*counts[node])
            if len(node[0]) < depth:
                below = sum(log_weighted(child) for child in children[node])
                high = max(own, below)
                own = high + math.log((math.exp(own - high) + math.exp(below - high)) / 2)
            weighted[node] = own
        return weighted[node]

    def one(before, prefix, d):
        node = before[:d], prefix
        if node not in counts:
            return 0.5
        zeros, ones = counts[node]
        own = (ones + 0.5) / (zeros + ones + 1)
        if d == depth:
            return own
        share = math.exp(math.log(0.5) + log_kt(zeros, ones) - log_weighted(node))
        return share * own + (1 - share) * one(before, prefix, d + 1)

    out = {}
    for token in tokens:
        total = 0.0
        for before, byte in _contexts(token, depth):
            prefix = 1
            for k in range(7, -1, -1):
                bit = byte >> k & 1
                p = one(before, prefix, 0)
                total += math.log10(p if bit else 1 - p)
                prefix = prefix << 1 | bit
        out[token] = total
    return out


def _plain(texts, depth):
    tokens, train, held = {}, Counter(), {}
    for key, (number, text) in enumerate(texts):
        found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b"\n"]
        held[key] = number is None or zlib.crc32(str(number).encode()) % 10 == 0
        tokens[key] = found
        if not held[key]:
            train.update(found)
    scores = _plain_scores(train, {t for found in tokens.values() for t in found}, depth)
    total, distinct = sum(train.values()), len(train)
    out = {}
    for key, found in tokens.items():
        base = sum(math.log10((train[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in found)
        out[key] = (held[key], len(found), sum(train[t] > 0 for t in found), total, base,
                    sum(scores[t] for t in found))
    return out


def _values(row):
    return (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score)


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_scores(spark, documents, depth, monkeypatch):
    """Several parts and shards, several runs of pairs; against the plain recursion."""
    monkeypatch.setattr(ct, "SHARD_BYTES", 4000)
    monkeypatch.setattr(ct, "PART_BYTES", 3000)
    texts = [(i, t[:300]) for i, t in documents[:40]] + [(900, "Ünï 日本 x\u0001y"), (901, "")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    whole = {n: b" ".join([*(t or "").encode().lower().split(), b"\n"]) for n, t in texts}
    train = Counter(t for n, t in whole.items() if zlib.crc32(str(n).encode()) % 10)
    wanted = _plain_scores(train, set(whole.values()), depth)
    rows = ct.score_running(frame, depth).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.score == pytest.approx(wanted[whole[row.doc_id]], rel=1e-6)


def test_hot_pair_and_large_counts(monkeypatch):
    """Runs of pairs one at a time and all at once, counts beyond the kept table."""
    import numpy as np

    chance = np.random.default_rng(4)
    tokens = [bytes(chance.choice(list(b"ab"), 6)) for _ in range(300)] + [b"ab" * 30]
    grams, _ = ct.byte_grams(tokens, 4)
    grams, n = ct._summed(grams, np.ones(len(grams)))
    n = n * chance.choice([0, 1, 40_000], len(n))
    order = np.argsort((ct._nearest_first(grams, 4) << 8) | (grams & 255))
    grams, n = grams[order], n[order]
    mixed, rest = np.full((256, 256), 0.2), np.full((256, 256), 0.6)
    found = []
    for size in (1, 50, 10_000):
        monkeypatch.setattr(ct, "GRAMS_AT_ONCE", size)
        trees = list(ct._subtrees(grams, n, 4))
        assert sum(len(t.byte) for t in trees) == len(grams)
        found.append(np.concatenate([t.log_probabilities(mixed, rest) for t in trees]))
    assert found[0] == pytest.approx(found[1]) and found[0] == pytest.approx(found[2])
    assert ct.log_estimate(np.array([0.0]), np.array([0.0])) == pytest.approx(0, abs=1e-8)


def test_contexts_run_across_words(spark, documents, monkeypatch):
    """Against the plain recursion over whole texts; an order of words is worth its bytes."""
    monkeypatch.setattr(ct, "PART_BYTES", 4000)
    monkeypatch.setattr(ct, "STRETCH_BYTES", 700)
    texts = [(i, t[:200]) for i, t in documents[:30]] + [(900, "Ünï 日本 x"), (901, "")]
    texts += [(2000 + i, "one two three four") for i in range(20)] + [(None, "four two three one")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    whole = {n: b" ".join([*(t or "").encode().lower().split(), b"\n"]) for n, t in texts}
    train = Counter(t for n, t in whole.items() if n is not None and zlib.crc32(str(n).encode()) % 10)
    rows = ct.score_running(frame, 6).collect()
    assert len(rows) == len(texts)
    wanted, bases = _plain_scores(train, set(whole.values()), 6), _plain(texts, 2)
    places = {number: key for key, (number, _) in enumerate(texts)}
    for row in rows:
        assert row.score == pytest.approx(wanted[whole[row.doc_id]], rel=1e-7)
        assert _values(row)[:5] == pytest.approx(bases[places[row.doc_id]][:5], rel=1e-9)
    by_id = {row.doc_id: row.score for row in rows}
    assert by_id[2000] > by_id[None] + 0.5
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    query = {r.doc_id: r.score for r in queries.op9_context_tree(spark, "").collect()}
    assert query == pytest.approx(by_id, rel=1e-9)


def test_running_ugly_rows(spark, ugly, empty):
    rows = ct.score_running(ugly).collect()
    assert len(rows) == ugly.count()
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert ct.score_running(empty).count() == 0
    only_held_out = spark.createDataFrame([(None, "some text")], "doc_id bigint, text string")
    assert [r.train_tokens for r in ct.score_running(only_held_out).collect()] == [0]


def test_query_base(spark, documents):
    wanted = _plain([(n, t) for n, t in documents], 2)
    rows = {r.doc_id: r for r in queries.op9_context_tree(spark, SF).collect()}
    assert len(rows) == len(documents)
    for key, (number, _) in enumerate(documents):
        row = rows[number]
        assert _values(row)[:5] == pytest.approx(wanted[key][:5], rel=1e-9)
        assert row.score < 0


def test_deeper_contexts_code_held_out_texts_shorter(spark, documents):
    frame = spark.createDataFrame(documents, "doc_id bigint, text string")
    totals = []
    for depth in (2, 4):
        rows = ct.score_running(frame, depth).where("held_out").collect()
        totals.append(sum(r.score for r in rows))
    letters = sum(len((t or "").encode()) + 1 for n, t in documents
                  if zlib.crc32(str(n).encode()) % 10 == 0)
    assert totals[0] < totals[1] < 0
    assert -totals[1] / math.log10(2) / letters < 4  # bits a byte


def test_held_out_texts_score_better_than_by_words(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_context_tree(spark, sf).where("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens


def test_probabilities_of_a_context_add_up():
    """Over all 256 bytes, in contexts that were seen in part and in one that was not."""
    import numpy as np

    grams, _ = ct.byte_grams([b"abc", b"abd", b"xbc"], 3)
    grams, counts = ct._summed(grams, np.ones(len(grams)))
    for before in (b"ab ", b"xb ", b"zzz"):
        context = before[1] | before[0] << 8 | before[2] << 16
        every = (context << 8) | np.arange(256)
        joined, n = ct._summed(np.concatenate([grams, every]),
                               np.concatenate([counts, np.zeros(256)]))
        order = np.argsort((ct._nearest_first(joined, 3) << 8) | (joined & 255))
        trees = ct.Subtrees(joined[order], n[order], 3)
        log10 = trees.log_probabilities(np.full((256, 256), 0.2), np.full((256, 256), 0.6))
        own = np.isin(joined[order], every)
        assert own.sum() == 256 and (10 ** log10[own]).sum() == pytest.approx(1)


def _block_rows(texts):
    import pyarrow as pa

    block = ct._Block(pa.int64())
    for number, text in enumerate(texts):
        block.add(number, number % 10 == 0, text)
    return list(block.rows(0, 2))


def _gram_rows(batches, parts=3):
    import pyarrow as pa

    schema = pa.schema([("block", pa.int64()), ("docs", pa.binary())])
    tables = (
        pa.RecordBatch.from_pylist([{"block": block, "docs": cell} for block, cell in cells], schema)
        for cells in batches
    )
    return [row for batch in ct._grams_of_blocks(6, parts)(tables) for row in batch.to_pylist()]


def test_memory_of_a_block_is_bounded():
    """N-grams of a block take a few numbers a byte of text at a time, not of all its text."""
    import tracemalloc

    import numpy as np

    chance = np.random.default_rng(7)
    sizes = chance.integers(2, 9, 300)
    vocabulary = [bytes(chance.choice(list(b"etaoin"), size).tolist()) for size in sizes]
    texts = [b" ".join(vocabulary[i] for i in chance.integers(0, 300, 500)) for _ in range(1600)]
    texts.append(b" ".join(texts[:300]))  # one text beyond what is looked at together
    assert len(texts[-1]) > 800_000
    cells = [(0, row[4]) for row in _block_rows(texts) if row[1] < 0]
    tracemalloc.start()
    _gram_rows([cells])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * sum(map(len, texts))


def test_grams_do_not_depend_on_cuts(monkeypatch):
    """Pieces of long texts, many short ones, large counts, a block that two tasks read."""
    import numpy as np

    texts = [b"", b"a", b"ab " * 900, *[b"x y%d" % (i % 7) for i in range(600)], b"\xff\xfe \x01"]
    plain = [b" ".join([*text.lower().split(), b"\n"]) for text in texts]
    wanted = Counter()
    for number, text in enumerate(plain):
        for before, byte in _contexts(text, 6):
            key = sum(b << 8 * (i + 1) for i, b in enumerate(before)) | byte
            wanted[key] += int(number % 10 != 0)
    every, owner = ct.byte_grams(plain)
    for most in (1, 7, 8, 100):
        runs = list(ct.gram_runs(plain, 6, most))
        assert max(len(grams) for grams, _ in runs) <= most
        assert (np.concatenate([grams for grams, _ in runs]) == every).all()
        assert (np.concatenate([places for _, places in runs]) == owner).all()
    assert not len(ct.byte_grams([])[0])
    monkeypatch.setattr(ct, "STRETCH_BYTES", 3000)
    monkeypatch.setattr(ct, "BYTES_AT_ONCE", 500)
    cells = [row[4] for row in _block_rows(texts) if row[1] < 0]
    assert len(cells) > 2
    whole = _gram_rows([[(0, cell) for cell in cells[:1]], [(0, cell) for cell in cells[1:]]])
    assert len(whole) == 3
    two_tasks = _gram_rows([[(0, cells[0])]]) + _gram_rows([[(0, cell) for cell in cells[1:]]])
    for rows in (whole, two_tasks):
        found = Counter()
        for row in rows:
            counts = ct._numbers(row["counts"], np.int64).tolist()
            for gram, n in zip(ct._unpacked_grams(row["grams"]).tolist(), counts):
                found[gram] += n
        assert found == wanted and max(found.values()) > ct._MOST
