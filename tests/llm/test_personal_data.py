"""Personal data against the patterns as they are written, tried at every place."""

from __future__ import annotations

import hashlib
import re
import time

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from garimpo.llm import personal_data as pd
from garimpo.llm import queries

from .conftest import SF

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value // 10 + value % 10
    return total % 10 == 0


def _brute(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match.group())
            good = {
                "email": lambda: True,
                "ip": lambda: max(map(int, match.group().split("."))) <= 255,
                "card": lambda: 12 <= len(digits) <= 19 and _luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((match.start(), rank, match.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def _base(text):
    return [(s.kind, s.start, s.end) for s in pd.find(text)[0]]


PARTS = ["a", "Z.", "%", "_", "@", "@", ".", "-", " ", "+", "1", "25", "255", "256", "0007",
         "(", ")", "4111111111111111", "378282246310005", "mail.example.com", "é", "\n", "x@y.z",
         "1.2.3.4", "+49 30 1234567", "٣"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
@example("a@b.cd_e@f.gh")
@example("1.2.3.4.5.6.7.8.9")
@example("a@b@c.d@e.f.")
@example("4111 1111-1111 1111 4111111111111111")
def test_base_as_the_patterns_say(text):
    assert _base(text) == _brute(text)


def test_runs_take_time_in_proportion():
    start = time.monotonic()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + " " * 300_000,
                 "a.b" * 100_000 + "@", "12:" * 100_000, "AB12 " * 60_000, ("9" * 40 + ".") * 8_000):
        pd.find(text)
    assert time.monotonic() - start < 30


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("transfer to DE89 3704 0044 0532 0130 00 today", "iban", "DE89 3704 0044 0532 0130 00"),
        ("transfer to GB82WEST12345698765432.", "iban", "GB82WEST12345698765432"),
        ("cpf 529.982.247-25", "cpf", "529.982.247-25"),
        ("her social security number is 078-05-1120", "ssn", "078-05-1120"),
        ("login from 2001:db8::8a2e:370:7334 seen", "ipv6", "2001:db8::8a2e:370:7334"),
        ("call 030 123 4567 now", "local_phone", "030 123 4567"),
        ("telefon (030) 1234-567", "local_phone", "(030) 1234-567"),
    ],
)
def test_further_kinds(text, kind, found):
    base, every = pd.find(text)
    assert [(s.kind, text[s.start : s.end]) for s in every if s not in base] == [(kind, found)]


@pytest.mark.parametrize(
    "text",
    [
        "transfer to DE88 3704 0044 0532 0130 00 today",  # wrong check digits
        "529.982.247-26", "111.111.111-11",
        "code 078-05-1120 of a part", "social security 000-05-1120",
        "ratio 12:30:45 and a::b", "the years 1990 1995 2002",
        "order phone 030 123 4567",  # a word for it, a word against it
    ],
)
def test_not_taken(text):
    assert pd.find(text)[1] == []


def test_words_near_by_change_the_score():
    scores = [
        pd.find(text)[1][0].score
        for text in ("the card 4111111111111111", "see 4111111111111111", "order 4111111111111111")
    ]
    assert scores == [100, 70, 30]


def test_base_spans_stay():
    text = "call +1 (274) 555-9629 or iban DE89370400440532013000, 4111 1111 1111 1111"
    base, every = pd.find(text)
    assert [s for s in every if s.kind in PATTERNS] == base
    assert {s.kind for s in every} == {"phone", "iban", "card"}
    assert pd.masked(text, every) == "call [PHONE] or iban [IBAN], [CARD]"


def test_query_on_whole_table(spark, documents):
    rows = {r.doc_id: r for r in queries.op12_personal_data(spark, SF).collect()}
    assert rows.keys() == {doc_id for doc_id, _ in documents}
    for doc_id, text in documents:
        wanted = _brute(text or "")
        row = rows[doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [
            sum(kind == name for kind, *_ in wanted) for name in PATTERNS
        ]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in wanted)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        kept = [s for s in row.spans.split(",") if s.split(":")[0] in PATTERNS]
        assert ",".join(kept) == joined


def test_ugly_and_empty(spark, ugly, empty):
    rows = pd.find_personal_data(ugly, keep=("doc_id", "_row")).collect()
    assert len(rows) == ugly.count()
    nothing = hashlib.sha256(b"").hexdigest()
    assert {(r.n_email, r.base_sha256, r.spans, r.masked) for r in rows if r.doc_id in (1, 2)} == {
        (0, nothing, "", "")
    }
    assert pd.find_personal_data(empty).collect() == []
    docs = spark.createDataFrame([(1, "write to a@b.c")], "doc_id long, text string")
    found = pd.find_personal_data(docs).first()
    assert found.found[0].asDict() == {
        "kind": "email", "start": 9, "end": 14, "score": 100, "text": "a@b.c"
    }
    assert found.masked == "write to [EMAIL]"
