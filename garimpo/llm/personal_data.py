"""Personal data in texts: patterns propose spans, checks confirm them, words near by count.

Every kind has a pattern that proposes spans, leftmost first and without overlap, and a
check of what it found: parts of an address, the Luhn digit of a card, mod 97 of an account
number, mod 11 of a tax number, ranges of a social security number. A proposal that fails is
dropped; the text it covered is not searched again. What is left has a score: that of its
kind, raised if words that go with the kind stand near by, lowered for words that speak
against it (an order number, a version).

Four kinds, the base, hold wherever their check does: e-mail and IP addresses, cards and
phones with a country code. The others must reach ``THRESHOLD``, and give way to base spans
and to better ones that they overlap.

Patterns take time in proportion to the text: those that could start inside a run of their
own letters start at its first letter, or where the last match ended, and keep what they took.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.llm.common import map_batches

#: Least score of a span of the further kinds.
THRESHOLD = 60
#: What a word near by adds or takes, and how far it may stand off, in characters.
RAISE, LOWER, NEAR = 30, 40, 48


def _luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def _digits(found: str) -> str:
    return "".join([c for c in found if "0" <= c <= "9"])


def is_ip(found: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in found.split("."))


def is_card(found: str) -> bool:
    digits = _digits(found)
    return 12 <= len(digits) <= 19 and _luhn(digits)


def is_phone(found: str) -> bool:
    return 9 <= len(_digits(found)) <= 15


#: Letters and digits of an account number by country, check digits included. Fixed values.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BR": 29, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SE": 24, "TR": 26,
}


def is_iban(found: str) -> bool:
    bare = found.replace(" ", "")
    if len(bare) != IBAN_LENGTHS.get(bare[:2], 0):
        return False
    turned = bare[4:] + bare[:4]
    return int("".join([str(int(c, 36)) for c in turned])) % 97 == 1


def is_cpf(found: str) -> bool:
    """Eleven digits, not all alike, whose last two check those before, mod 11."""
    digits = [int(c) for c in _digits(found)]
    if len(digits) != 11 or len(set(digits)) == 1:
        return False
    for size in (9, 10):
        total = sum(d * (size + 1 - i) for i, d in enumerate(digits[:size]))
        if digits[size] != total * 10 % 11 % 10:
            return False
    return True


def is_ssn(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def is_ipv6(found: str) -> bool:
    try:
        return not ipaddress.IPv6Address(found).is_unspecified
    except ValueError:
        return False


def is_local_phone(found: str) -> bool:
    return 7 <= len(_digits(found)) <= 12


@dataclass(frozen=True)
class Kind:
    """A pattern with its check; ``hint`` must stand in a text for the pattern to be tried."""

    name: str
    pattern: regex.Pattern
    check: Callable[[str], bool] | None
    hint: str
    score: int
    words: frozenset[str]
    against: frozenset[str] = frozenset()


def _run(letters: str) -> str:
    """The start of a run of ``letters``, or the place where the last match ended."""
    return rf"(?:\G|(?<![{letters}]))"


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_LOCAL = "A-Za-z0-9._%+-"
_NUMBERED = _words("order invoice version isbn serial bestellung rechnung pedido factura commande")

#: Kinds whose spans stand by their check alone, in the order of equal starts.
BASE = (
    Kind(
        "email",
        regex.compile(
            _run(_LOCAL) + rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
        ),
        None, "@", 90, _words("mail email e-mail contact kontakt correo courriel write"),
        _words("example noreply no-reply"),
    ),
    Kind(
        "ip",
        regex.compile(_run("0-9") + r"[0-9]++(?:\.[0-9]++){3}"),
        is_ip, ".", 70, _words("ip address host server login from adresse direccion"),
        _words("version release build section"),
    ),
    Kind(
        "card", regex.compile(r"[0-9](?:[ -]?[0-9])++"), is_card, "", 70,
        _words("card visa mastercard amex credit debit karte kreditkarte tarjeta carte cartao"),
        _NUMBERED,
    ),
    Kind(
        "phone", regex.compile(r"\+[0-9][ ().0-9-]+[0-9]"), is_phone, "+", 80,
        _words("phone tel telephone call mobile fax telefon handy telefono movil telefone"),
    ),
)

#: Kinds that need their score, most telling first.
FURTHER = (
    Kind(
        "iban",
        regex.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
                      r"(?![A-Za-z0-9])"),
        is_iban, "", 90, _words("iban account bank konto cuenta compte conta"),
    ),
    Kind(
        "cpf",
        regex.compile(r"(?<![0-9.-])[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}(?![0-9])"),
        is_cpf, "-", 80, _words("cpf contribuinte documento"),
    ),
    Kind(
        "ssn",
        regex.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
        is_ssn, "-", 50, _words("ssn social security"), _NUMBERED,
    ),
    Kind(
        "ipv6",
        regex.compile(_run("0-9A-Fa-f:.") + r"[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+"
                      r"(?![0-9A-Za-z:])"),
        is_ipv6, ":", 40, _words("ip ipv6 address host server login adresse direccion"),
    ),
    Kind(
        "local_phone",
        regex.compile(r"(?<![0-9+A-Za-z.-])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,5}){1,3}(?![0-9A-Za-z])"),
        is_local_phone, "", 40,
        _words("phone tel telephone call mobile fax telefon handy telefono movil telefone"),
        _NUMBERED,
    ),
)

KINDS = tuple(kind.name for kind in (*BASE, *FURTHER))

_WORD = regex.compile(r"[^\W_]+(?:-[^\W_]+)*")


@dataclass(frozen=True, slots=True)
class Span:
    """Code points from ``start`` up to ``end``."""

    kind: str
    start: int
    end: int
    score: int


def proposals(kind: Kind, text: str) -> Iterator[tuple[int, int]]:
    """Spans of a kind that pass its check."""
    for match in kind.pattern.finditer(text):
        if kind.check is None or kind.check(match.group()):
            yield match.span()


def context_score(kind: Kind, text: str, start: int, end: int) -> int:
    """The kind's score and what the words near a span add or take, 0 to 100."""
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    words = set(_WORD.findall(near.lower()))
    score = kind.score + RAISE * bool(words & kind.words) - LOWER * bool(words & kind.against)
    return min(100, max(0, score))


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds by start, then kind."""
    found = []
    for rank, kind in enumerate(BASE):
        if kind.hint in text:
            found += [(a, rank, b) for a, b in proposals(kind, text)]
    return [
        Span(BASE[rank].name, a, b, context_score(BASE[rank], text, a, b))
        for a, rank, b in sorted(found)
    ]


def further_spans(text: str, taken: list[Span]) -> list[Span]:
    """Spans of the other kinds: high enough in score and clear of ``taken`` and better ones."""
    found = []
    for rank, kind in enumerate(FURTHER):
        if kind.hint in text:
            for a, b in proposals(kind, text):
                score = context_score(kind, text, a, b)
                if score >= THRESHOLD:
                    found.append((-score, rank, a, b))
    if not found:
        return []
    covered = bytearray(len(text))
    for span in taken:
        covered[span.start : span.end] = b"\1" * (span.end - span.start)
    kept = []
    for loss, rank, a, b in sorted(found):
        if not any(covered[a:b]):
            covered[a:b] = b"\1" * (b - a)
            kept.append(Span(FURTHER[rank].name, a, b, -loss))
    return kept


_DIGIT = regex.compile("[0-9@:]")


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, both by start and then kind."""
    if not _DIGIT.search(text):
        return [], []
    base = base_spans(text)
    more = further_spans(text, base)
    every = sorted([*base, *more], key=lambda s: (s.start, KINDS.index(s.kind), s.end))
    return base, every


def spell(spans: list[Span]) -> str:
    return ",".join([f"{s.kind}:{s.start}:{s.end}" for s in spans])


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span as ``[KIND]``; of overlapping ones the first stays, which
    then covers the others too."""
    parts, place = [], 0
    for span in spans:
        if span.start >= place:
            parts += [text[place : span.start], f"[{span.kind.upper()}]"]
        place = max(place, span.end)
    return "".join([*parts, text[place:]])


_COUNTS = T.StructType([T.StructField(f"n_{kind.name}", T.LongType()) for kind in BASE])
_DIGEST = T.StructType([*_COUNTS]).add("base_sha256", "string").add("spans", "string")
_FULL = T.StructType([*_DIGEST]).add(
    "found",
    T.ArrayType(
        T.StructType().add("kind", "string").add("start", "long").add("end", "long")
        .add("score", "integer").add("text", "string")
    ),
).add("masked", "string")


def find_personal_data(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    with_texts: bool = True,
) -> DataFrame:
    """``keep`` columns and what was found in every whole text.

    ``n_email``, ``n_ip``, ``n_card``, ``n_phone``; ``base_sha256`` over
    ``kind:start:end`` of the base spans, joined by commas; ``spans``, all spans written
    alike. ``with_texts`` adds ``found`` (kind, start, end, score and text of every span)
    and the ``masked`` text. A missing or empty text has none: zeros, the digest of nothing,
    empty strings. Equal rows give equal rows, ids may be missing; other columns are left
    out; an empty table gives an empty one. Spans of equal start stand in the order of
    their kinds.
    """
    schema = _FULL if with_texts else _DIGEST

    def make():
        def work(columns):
            out: dict[str, list] = {f.name: [] for f in schema}
            for value in columns["_text"]:
                value = value or ""
                base, every = find(value)
                for kind in BASE:
                    out[f"n_{kind.name}"].append(sum(s.kind == kind.name for s in base))
                out["base_sha256"].append(sha256(spell(base).encode()).hexdigest())
                out["spans"].append(spell(every))
                if with_texts:
                    out["found"].append(
                        [
                            {"kind": s.kind, "start": s.start, "end": s.end, "score": s.score,
                             "text": value[s.start : s.end]}
                            for s in every
                        ]
                    )
                    out["masked"].append(masked(value, every))
            return out

        return work

    read = docs.select(*[F.col(f"`{name}`") for name in keep], F.col(f"`{text}`").alias("_text"))
    return map_batches(read, make, schema, keep)
