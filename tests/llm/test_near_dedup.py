"""Near-duplicates and components against brute force."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest

from garimpo.llm import near_dedup as nd
from garimpo.llm import queries
from garimpo.llm.components import components

from .conftest import SF


def _find(parent, a):
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    return a


def _plain_components(links, nodes=()):
    parent = {n: n for n in nodes}
    for a, b in links:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = _find(parent, a), _find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: _find(parent, n) for n in parent}


def _plain_sets(texts):
    out = {}
    for number, text in texts:
        found = (text or "").encode().lower().split()
        windows = {tuple(found[i : i + 4]) for i in range(len(found) - 3)}
        out[number] = windows or ({tuple(found)} if found else set())
    return out


def _plain_near(texts):
    sets = _plain_sets(texts)
    numbers = sorted(n for n in sets if sets[n])
    links = []
    for i, a in enumerate(numbers):
        for b in numbers[i + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small < 80 * large:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                links.append((a, b))
    return sets, _plain_components(links, sets)


def _check(rows, texts):
    sets, wanted = _plain_near(texts)
    assert len(rows) == len(texts)
    for row in rows:
        assert row.n_shingles == len(sets[row.doc_id])
        assert row.component_id == wanted[row.doc_id]
        assert row.kept == (row.doc_id == row.component_id)


def test_query(spark, documents):
    _check(queries.op2_near_dedup(spark, SF).collect(), documents)


def test_chains_hubs_and_crowds(spark):
    """Chains of small edits, a crowd of near copies, and texts that share a passage."""
    chance = random.Random(4)
    letters = [f"w{i}" for i in range(3000)]
    passage = chance.choices(letters, k=60)
    texts = []

    def add(words):
        texts.append((len(texts), " ".join(words)))

    words = chance.choices(letters, k=120)
    for step in range(30):  # each near the one before, the ends far apart
        add(words)
        words = [*words]
        words[(4 * step) % 120] = f"new{step}"
    base = chance.choices(letters, k=200)
    for i in range(60):  # variants of one text, pairs of them just about 0.8 similar
        own = [*base]
        for _ in range(5):
            own[chance.randrange(200)] = f"v{i}"
        add(own)
    for _ in range(60):  # a passage in common and little else
        add(passage + chance.choices(letters, k=25))
    for _ in range(40):  # copies in another case and other blanks
        add(["  ".join(base).upper() + "\n"])
    rows = nd.near_duplicates(
        spark.createDataFrame(texts, "doc_id bigint, text string").repartition(7)
    ).collect()
    _check(rows, texts)


def test_texts_just_too_far_apart_cost_no_full_comparison(spark, monkeypatch):
    """A crowd around one text, each a little below 0.8 of all others: few pairs are read."""
    chance = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = [(0, " ".join(base))]
    for i in range(1, 90):
        own = [*base]
        for place in chance.sample(range(0, 200, 5), 7):
            own[place] = f"v{i}x{place}"
        texts.append((i, " ".join(own)))
    read = []
    confirmed = nd.confirmed

    def counted(pairs, docs, text):
        read.append(pairs.count())
        return confirmed(pairs, docs, text)

    monkeypatch.setattr(nd, "confirmed", counted)
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    _check(nd.near_duplicates(docs).collect(), texts)
    assert sum(read) < 3 * len(texts)


def test_words_of_a_shingle(spark, monkeypatch):
    """A 40-word pair, one inner word apart: linked with four words, apart with five."""
    words = [f"w{i}" for i in range(40)]
    changed = [*words[:20], "other", *words[21:]]
    texts = [(1, " ".join(words)), (2, " ".join(changed)), (3, "one two three four")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    four = {r.doc_id: (r.n_shingles, r.kept) for r in queries.op2_near_dedup(spark, "").collect()}
    assert four == {1: (37, True), 2: (37, False), 3: (1, True)}
    staged = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    assert sorted(r.doc_id for r in staged) == [1, 2, 3]
    five = nd.near_duplicates(docs, size=5).collect()
    assert sorted((r.doc_id, r.n_shingles) for r in five) == [(1, 36), (2, 36), (3, 1)]
    # Near copies are still found: two words of a hundred.
    words = [f"w{i}" for i in range(100)]
    near = [(1, " ".join(words)), (2, " ".join([*words[:98], "x", "y"]))]
    near = spark.createDataFrame(near, "doc_id bigint, text string")
    assert [r.doc_id for r in nd.keep_one(near, 5).collect()] == [1]


def test_parities_never_part_what_is_similar():
    """Bits that differ are at most the shingles that only one set has, at any size."""
    chance = np.random.default_rng(2)
    for n in (1, 4, 30, 300, 3000, 30_000):
        pool = nd._mix(chance.integers(0, 1 << 62, 2 * n, dtype=np.uint64))
        for own in {0, n // 9, n // 2, n}:
            a, b = pool[:n], pool[own : own + n]
            apart = sum(int(x).bit_count() for x in
                        (nd.parity_of(a) ^ nd.parity_of(b)).view(np.uint64))
            assert apart <= 2 * own
            if 20 * n <= nd.PARITY_BITS * 10 and own:
                assert apart >= own


def test_very_long_text_is_hashed_in_stretches(monkeypatch):
    words = [b"word%d" % (i * 10 % 1001) for i in range(5000)]
    text = b" ".join(words)
    whole = nd.WordHashes()(text)
    monkeypatch.setattr(nd, "_PIECE", 500)
    assert (nd.WordHashes()(text) == whole).all()
    assert len(np.unique(whole)) == 1001
    spaced = b"\n\t ".join(words) + b" "
    assert (nd.WordHashes()(spaced) == whole).all()


def test_estimate():
    """Equal minima estimate the similarity."""
    chance = np.random.default_rng(1)
    pool = nd._mix(chance.integers(0, 1 << 62, 30_000, dtype=np.uint64))
    shares = []
    for k in range(100):
        own = pool[k * 300 : k * 300 + 300]
        a, b = nd.minima_of(own[:270]), nd.minima_of(own[30:])
        shares.append((a == b).mean())
    assert abs(np.mean(shares) - 0.8) < 0.02
    assert (np.array(shares) * nd.MINIMA > nd.ALIKE).all()


def test_ugly_rows(spark, ugly, empty):
    rows = nd.near_duplicates(ugly).collect()
    assert len(rows) == ugly.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by_id[i].n_shingles for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert all(by_id[i].kept for i in (1, 2, 3, 4, 5, 9))
    assert by_id[6].component_id == 5 and by_id[8].component_id == 7
    lost = [r for r in rows if r.doc_id is None]
    assert len(lost) == 2 and all(r.kept and r.component_id is None for r in lost)
    assert nd.near_duplicates(empty).count() == 0

    kept = nd.keep_one(ugly)
    assert kept.schema == ugly.schema
    left = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert left == [1, 2, 3, 4, 5, 7, 9, 10, 11]
    assert kept.where("doc_id is null").count() == 2


def test_survivor_of_one_id_and_odd_names(spark):
    rows = [(1, "b c d e f", 1), (1, "a c d e f", 2), (1, "a c d e f", 3), (None, "x", 4),
            (None, "x", 4), (2, None, 5), (2, "z", 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `meta.n` int")
    for dealt in (1, 5):
        got = nd.keep_one(frame.repartition(dealt))
        assert got.schema == frame.schema
        kept = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
        assert kept == [(0, "x"), (0, "x"), (1, "a c d e f"), (2, "")]
    assert len({nd.keep_one(frame.repartition(n)).where("doc_id = 1").first()["meta.n"]
                for n in (1, 3, 7)}) == 1


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    chance = random.Random(9)
    links = {
        "chain": [(i, i + 1) for i in range(200)][::-1],
        "star": [(500, i) for i in range(300)] + [(i, i) for i in range(600, 603)],
        "random": [(chance.randrange(400), chance.randrange(400)) for _ in range(220)],
        "none": [],
    }[kind]
    frame = spark.createDataFrame([*links, (None, 1)], "u bigint, v bigint")
    got = {r.node: r.component for r in components(frame).collect()}
    wanted = _plain_components((a, b) for a, b in links if a != b)
    assert got == wanted
