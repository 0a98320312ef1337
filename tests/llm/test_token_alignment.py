"""Token alignment against a byte-by-byte comparison of both tokenizers' whole output."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from garimpo.llm import queries, token_alignment as ta

from .conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

LETTERS = "ab thing's 12 !?-é ßüΣ İ́\n\t\r\x1c\xa0　日本한👍🏽▁<|endoftext|> <s><0x41>\x00"


def _tokens(text):
    """(id, start, end) of both tokenizers over the whole text, from decoded bytes alone."""
    both = ta.load(A, B)
    if not text:
        return [], []
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    found = []
    for ids, names in ((a, both.bytes_a), (b, both.bytes_b)):
        if b"".join(names[i] for i in ids) != (" " + text).encode():
            return [], []
        place, spans = 0, []
        for i in ids:
            spans.append((i, place, place + len(names[i])))
            place += len(names[i])
        found.append(spans)
    return found


def _brute(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every text."""
    links, out = [], []
    for text in texts:
        a, b = _tokens(text)
        links.append([(i, j) for i, s, e in a for j, t, f in b if s < f and t < e])
        ends = sorted({e for _, _, e in a} & {f for _, _, f in b})
        groups, last = [], 0
        for end in ends:
            sides = [",".join(str(i) for i, s, e in x if last <= s and e <= end) for x in (a, b)]
            groups.append("|".join(sides))
            last = end
        out.append([len(a), len(b), len(ends), len(links[-1]), ";".join(groups)])
    counts = Counter(pair for part in links for pair in part)
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [
        (*row[:4], sum(counts[i, j] == best[j] for i, j in part),
         sum(counts[pair] for pair in part), row[4])
        for row, part in zip(out, links)
    ]


def _check(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in ta.align_documents(docs, A, B, **options).collect()}
    assert len(got) == len(texts)
    for place, row in enumerate(_brute(texts)):
        mine = got[place]
        assert (mine.n_a, mine.n_b, mine.n_groups, mine.n_links) == row[:4], texts[place]
        assert (mine.n_best, mine.count_sum, mine.groups) == row[4:], texts[place]
        wanted = hashlib.sha256(row[6].encode()).hexdigest() if row[6] else ""
        assert mine.groups_sha256 == wanted


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(LETTERS), max_size=50))
def test_chunks_join_to_the_whole(text):
    both = ta.load(A, B)
    keys = ta.split_chunks(text) if text else []
    assert "".join(map(ta.chunk_text, keys)) == (" " + text if text else "")
    chunks = ta.Chunks()
    ta._learn(chunks, both, list(dict.fromkeys(keys)))
    numbers = [chunks.number[key] for key in keys]
    groups = ";".join(chunks.groups[i] for i in numbers)
    wanted = _brute([text])[0]
    if all(chunks.counts[i, 3] >= 0 for i in numbers):
        assert groups == wanted[6]
        assert tuple(chunks.counts[numbers].sum(0)) == wanted[:4]
    else:
        assert wanted[0] == 0


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from(LETTERS), min_size=1, max_size=30))
def test_spans_are_the_bytes(text):
    got = ta.load(A, B).align(" " + text)
    a, b = _tokens(text)
    if got is None:
        assert not a
    else:
        assert got.a_ends.tolist() == [end for _, _, end in a]
        assert got.b_ends.tolist() == [end for _, _, end in b]


@pytest.mark.parametrize("block_chars", [1, 40, 10_000])
def test_counts_over_all_blocks(spark, block_chars):
    texts = [
        "the cat sat on the mat", "", None, " ", "  two  blanks ", "日本語 text 👍🏽 é",
        "the cat sat on the mat", "a▁b is lost", "line\nbreaks\n\nhere \n", "the the the the",
        "<|endoftext|> and <s> are text", "\nstart", "x" * 300, "tab\there",
    ]
    _check(spark, [text or "" for text in texts], block_chars=block_chars)
    docs = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    row = ta.align_documents(docs, A, B).first()
    assert (row.n_a, row.count_sum, row.groups_sha256, row.groups) == (0, 0, "", "")


def test_uncut_texts_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ta.load(A, B), "cuts", False)
    got = ta.Chunks()
    text = "uncut texts\nare one chunk "
    key = ta.split_chunks(text, False)
    ta._learn(got, ta.load(A, B), key)
    assert got.groups[0] == _brute([text])[0][6]


def test_query_on_whole_table(spark, documents):
    got = {r.doc_id: r for r in queries.op11_token_alignment(spark, SF).collect()}
    some = [text or "" for _, text in documents]
    # Pairs by elementary stretches of bytes; the quadratic form above is for short texts.
    links = []
    for text in some:
        a, b = _tokens(text)
        i = j = 0
        part = []
        while i < len(a):
            part.append((a[i][0], b[j][0]))
            one, two = a[i][2], b[j][2]
            i, j = i + (one <= two), j + (two <= one)
        links.append(part)
    counts = Counter(pair for part in links for pair in part)
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    for (doc_id, _), part in zip(documents, links):
        assert got[doc_id].n_links == len(part)
        assert got[doc_id].count_sum == sum(counts[pair] for pair in part)
        assert got[doc_id].n_best == sum(counts[i, j] == best[j] for i, j in part)
    assert got.keys() == {doc_id for doc_id, _ in documents}


def test_ugly_and_empty(spark, ugly, empty):
    got = ta.align_documents(ugly, A, B, keep=("doc_id", "_row", "_bytes"))
    rows = got.collect()
    assert len(rows) == ugly.count()
    assert sorted(r.n_a for r in rows if r.doc_id == 9)[0] > 10
    assert ta.align_documents(empty, A, B).collect() == []
