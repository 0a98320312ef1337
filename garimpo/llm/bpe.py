"""Exact BPE by backtracking over longest token matches, and decoding by an offset table.

The merges of a BPE vocabulary have one result for a word. It is found here without
replaying the merges: an Aho-Corasick automaton over all tokens gives the longest token at
every place of the word; tokens are taken from left to right; a token may follow another
only if the merges would have kept the border between the two (the compatibility of the
pair, worked out once per pair and kept in a table); where nothing fits, the last token is
replaced by the next shorter one. Places found to lead nowhere are marked, so each is left
once and a word takes time in proportion to its length.

Decoding looks every id up in one table of offsets into the joined token strings.
"""

from __future__ import annotations

import functools
import json
import struct
import unicodedata

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.llm.common import map_batches

#: Entries of a table of words or pairs, per Python worker; a full table starts anew.
TABLE_ENTRIES = 700_000
#: Longer pieces are not kept in the table of words.
KEPT_LENGTH = 48

_END = " "  # ends a word inside the automaton; no byte is written as a space there
_SUFFIX = "</w>"
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_UNSPACED = regex.compile(r"[^\p{White_Space}]+")
# Separators that str.split parts by although they are no white space.
_NOT_SPACE = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBPE:
    """A BPE vocabulary with word ends, read from a tokenizers JSON file.

    Covers what such a file holds: added tokens found in the raw text, NFC, lower case,
    white space dropped, pieces by pattern, byte-level letters, ``</w>`` at word ends.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary: dict[str, int] = spec["model"]["vocab"]
        self.size = max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        names = [""] * self.size
        for text, number in vocabulary.items():
            names[number] = text
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, number in added.items():
            names[number] = text
        self.names = names
        self.added = {text: np.uint32(number).tobytes() for text, number in added.items()}
        self._added = (
            regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        )

        self.left = [-1] * self.size
        self.right = [-1] * self.size
        self.merged: dict[tuple[int, int], int] = {}
        self.made = [-1] * self.size  # when the merges make a token; letters are there at once
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            number = vocabulary[a + b]
            self.left[number], self.right[number] = vocabulary[a], vocabulary[b]
            self.merged[vocabulary[a], vocabulary[b]] = number
            self.made[number] = rank

        self.length = [0] * self.size
        self.matches = ahocorasick.Automaton()
        for text, number in vocabulary.items():
            if self.left[number] < 0 or self._stands(number):
                shape = text[: -len(_SUFFIX)] + _END if text.endswith(_SUFFIX) else text
                self.length[number] = len(shape)
                self.matches.add_word(shape, number)
        self.shorter = [-1] * self.size
        for shape, number in list(self.matches.items()):
            for cut in range(len(shape) - 1, 0, -1):
                if self.matches.exists(shape[:cut]):
                    self.shorter[number] = self.matches.get(shape[:cut])
                    break
        self.matches.make_automaton()

        self.letters = byte_letters()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._known: dict[str, bytes] = {}
        strings = [name.encode("utf-8") + b" " for name in names]
        self.offsets = np.zeros(self.size + 1, np.int64)
        np.cumsum([len(s) for s in strings], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(strings), np.uint8)

    # Borders ------------------------------------------------------------------------

    def _border_kept(self, a: int, b: int, whole: int = -1) -> bool:
        """Do the merges of ``a`` next to ``b`` leave the border alone (up to ``whole``)?

        Take both apart along the border, undoing the later merge first. A merge across
        the border comes about if it ranks before the merge that next takes its left part
        away, and not after the one that takes its right part: of equal merges the left
        one goes first.
        """
        made = self.made
        last = len(made)
        taken_a = taken_b = last
        while True:
            across = self.merged.get((a, b), -1)
            if across >= 0 and across != whole:
                if made[across] < taken_a and made[across] <= taken_b:
                    return False
            if made[a] < 0 and made[b] < 0:
                return True
            if made[a] > made[b]:
                taken_a, a = made[a], self.right[a]
            else:
                taken_b, b = made[b], self.left[b]
            whole = -1

    def _stands(self, number: int) -> bool:
        """Do the merges of a token's own letters give this token?"""
        a, b = self.left[number], self.right[number]
        return self._border_kept(a, b, number) and all(
            self.left[x] < 0 or self._stands(x) for x in (a, b)
        )

    def fits(self, a: int, b: int) -> bool:
        """May token ``b`` follow token ``a`` inside a word? Kept in the table of pairs."""
        if len(self._pairs) >= TABLE_ENTRIES:
            self._pairs.clear()
        known = self._pairs[a, b] = self._border_kept(a, b)
        return known

    def forget(self) -> None:
        """Empty the tables of words and pairs; they fill again as needed."""
        self._pairs = {}
        self._known = {}

    # Encoding -----------------------------------------------------------------------

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece, given in byte letters."""
        word += _END
        size, length, shorter = len(word), self.length, self.shorter
        longest = [-1] * size
        for end, number in self.matches.iter(word):
            longest[end + 1 - length[number]] = number  # a later end is a longer match
        if length[longest[0]] == size:
            return [longest[0]]
        ids: list[int] = []
        dead: set[int] = set()
        place, token = 0, longest[0]
        pairs = self._pairs
        while place < size:
            if token < 0:
                dead.add(place)
                last = ids.pop()
                place -= length[last]
                token = shorter[last]
                continue
            end = place + length[token]
            fit = end not in dead
            if fit and ids:
                fit = pairs.get((ids[-1], token))
                if fit is None:
                    fit = self.fits(ids[-1], token)
            if fit:
                ids.append(token)
                place = end
                token = longest[place] if place < size else -1
            else:
                token = shorter[token]
        return ids

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the pattern."""
        known = self._known.get(piece)
        if known is not None:
            return known
        shape = piece
        if not (piece.isascii() and piece.isprintable()):
            shape = "".join([self.letters[b] for b in piece.encode("utf-8", "replace")])
        ids = self.encode_word(shape)
        return self._keep(piece, struct.pack(f"<{len(ids)}I", *ids))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch without white space."""
        if chunk.isalpha():
            return self._piece(chunk)
        return self._keep(chunk, b"".join([self._piece(x) for x in _PIECES.findall(chunk)]))

    def _keep(self, text: str, ids: bytes) -> bytes:
        if len(text) <= KEPT_LENGTH:
            if len(self._known) >= TABLE_ENTRIES:
                self._known.clear()
            self._known[text] = ids
        return ids

    def _plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        parts = _UNSPACED.findall(text) if _NOT_SPACE.search(text) else text.split()
        ids = list(map(self._known.get, parts))
        if None in ids:
            ids = [self._chunk(x) if y is None else y for x, y in zip(parts, ids)]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self._added is None or "<|" not in text:
            return b"".join(self._plain(text))
        ids: list[bytes] = []
        for part in self._added.split(text):
            ids.extend([self.added[part]] if part in self.added else self._plain(part))
        return b"".join(ids)

    # Decoding -----------------------------------------------------------------------

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the token strings, parted by spaces; the file names no decoder."""
        numbers = np.frombuffer(ids, "<u4")
        if not len(numbers):
            return b""
        start = self.offsets[numbers]
        length = self.offsets[numbers + 1] - start
        ends = np.cumsum(length)
        places = np.repeat(start - (ends - length), length)
        places += np.arange(ends[-1])
        return self.blob[places].tobytes()[:-1]


@functools.cache
def load(path: str) -> WordBPE:
    """One vocabulary, and its tables of words and pairs, per Python worker."""
    return WordBPE(path)


def encode_documents(
    docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    with_ids: bool = True,
) -> DataFrame:
    """``keep`` columns, ``ids``, ``decoded``, and the digests of both, of every row.

    A missing or empty text has no ids and an empty decoding; equal rows stay equal rows;
    other columns are left out; an empty table gives an empty one. ``with_ids=False``
    leaves ``ids`` and ``decoded`` out. ``path`` must be readable on every executor.
    """
    from hashlib import sha256

    digests = T.StructType().add("n_tokens", "long").add("ids_sha256", "string")
    digests = digests.add("decoded_sha256", "string")
    schema = T.StructType(digests.fields)
    if with_ids:
        schema = T.StructType(
            [T.StructField("ids", T.ArrayType(T.LongType())),
             T.StructField("decoded", T.StringType()), *digests.fields]
        )

    def make():
        vocabulary = load(path)

        def work(columns):
            out: dict[str, list] = {f.name: [] for f in schema}
            for value in columns["_text"]:
                ids = vocabulary.encode(value or "")
                decoded = vocabulary.decode(ids)
                if with_ids:
                    out["ids"].append(np.frombuffer(ids, "<u4").astype(np.int64))
                    out["decoded"].append(decoded.decode("utf-8"))
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(sha256(ids).hexdigest())
                out["decoded_sha256"].append(sha256(decoded).hexdigest())
            return out

        return work

    return map_batches(
        docs.select(*keep, F.col(text).alias("_text")), make, schema, keep
    )
