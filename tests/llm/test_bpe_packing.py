"""BPE against the tokenizers library; packing against its own accounts."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from garimpo.llm import bpe, packing, queries

from .conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _same(library, text):
    wanted = library.encode(text, add_special_tokens=False).ids
    ours = bpe.load(PATH).encode(text)
    assert np.frombuffer(ours, "<u4").tolist() == wanted, text[:80]
    decoded = library.decode(wanted, skip_special_tokens=False)
    assert bpe.load(PATH).decode(ours).decode() == decoded


LETTERS = "abcdefthingsou 's't're 12 !?*-é ßüΣσς İ́\n\t\x1c\xa0日本語한국👍🏽<|endoftext|> </w>'llAB\x00"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(LETTERS), max_size=60))
def test_odd_texts(text):
    tokenizer = Tokenizer.from_file(PATH)
    _same(tokenizer, text)


@pytest.mark.parametrize(
    "text",
    ["", " ", "a" * 4000, "ab" * 2000 + "!", "thththth" * 1000, "the<|endoftext|>the",
     "<|endoftext|><|startoftext|> <|endoftext|>x", "don't WE'LL it's 's"],
)
def test_corners(library, text):
    _same(library, text)


def test_every_token_stands():
    vocabulary = bpe.load(PATH)
    assert all(vocabulary.length[i] for i in range(len(vocabulary.names) - 2))


def test_table_starts_anew(library, documents, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_ENTRIES", 50)
    small = bpe.WordBPE(PATH)
    for _, text in documents[:20]:
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(small.encode(text), "<u4").tolist() == wanted
    assert len(small._known) <= 50


def test_query(spark, library, documents):
    rows = {r.doc_id: r for r in queries.op10_bpe(spark, SF).collect()}
    assert len(rows) == len(documents)
    for number, text in documents:
        ids = library.encode(text, add_special_tokens=False).ids
        row = rows[number]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_ugly_rows(spark, library, ugly, empty):
    rows = bpe.encode_documents(ugly, PATH).collect()
    assert len(rows) == ugly.count()
    texts = sorted((r.text or "") for r in ugly.collect())
    wanted = sorted(library.encode(t, add_special_tokens=False).ids for t in texts)
    assert sorted(r.ids for r in rows) == wanted
    assert bpe.encode_documents(empty, PATH).count() == 0


# Packing ----------------------------------------------------------------------------


def _account(rows, sizes, window=packing.WINDOW):
    """Pieces of (number, start, length, total, sequence, offset); sizes by number."""
    sequences, parts = {}, {}
    for number, start, length, total, sequence, offset in rows:
        assert length > 0
        sequences.setdefault(sequence, []).append((offset, length))
        parts.setdefault(number, []).append((start, length, total))
    padding = 0
    for pieces in sequences.values():
        filled = 0
        for offset, length in sorted(pieces):
            assert offset == filled
            filled += length
        assert filled <= window
        if filled & (filled - 1):
            padding += window - filled
    for number, pieces in parts.items():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at and total == sizes[number]
            at += length
        assert at == sizes[number]
    assert set(parts) == set(sizes)
    return padding


def test_level_array_picks_the_least_sum_of_squares():
    window = 64
    chance = np.random.default_rng(3)
    levels = packing.LevelArray(window)
    for number in range(500):
        size = int(chance.integers(1, window))
        before = levels.count.copy()

        def after(level):
            counts = before.copy()
            if level:
                counts[level] -= 1
            if level + size < window:
                counts[level + size] += 1
            return int((counts**2).sum())

        choices = [0, *[h for h in range(1, window - size + 1) if before[h]]]
        levels.place((number, 0, np.zeros(size, np.uint32), size))
        assert int((levels.count**2).sum()) == min(map(after, choices))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_every_id_in_one_piece(lengths):
    documents = [(i, np.arange(n, dtype=np.uint32) + 1000 * i) for i, n in enumerate(lengths)]
    rows, seen = [], {i: {} for i in range(len(lengths))}
    for sequence, pieces in enumerate(packing.pack(iter(documents), 64)):
        offset = 0
        for number, start, ids, total in pieces:
            rows.append((number, start, len(ids), total, sequence, offset))
            seen[number][start] = ids
            offset += len(ids)
    assert _account(rows, dict(enumerate(lengths)), 64) == 0
    for number, ids in documents:
        joined = np.concatenate([seen[number][at] for at in sorted(seen[number])])
        assert (joined == ids).all()


def test_query_packs_all(spark, library, documents):
    rows = queries.op5_packing(spark, SF).collect()
    ids = {n: [*library.encode(t, add_special_tokens=False).ids, 2] for n, t in documents}
    padding = _account(
        [(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in rows],
        {number: len(own) for number, own in ids.items()},
    )
    assert padding == 0
    for row in rows:
        own = ids[row.doc_id][row.start : row.start + row.length]
        assert row.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())


def test_ugly_documents_are_packed(spark, ugly, empty):
    rows = packing.pack_documents(ugly, PATH).collect()
    assert sum(r.length for r in rows) == sum(len(r.ids) for r in rows)
    whole = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert [r.ids for r in whole] == [[2]] * 3
    assert sum(r.start == 0 for r in rows if r.doc_id == 9) == 2
    assert packing.pack_documents(empty, PATH).count() == 0
