"""Near-duplicates by MinHash: many minima, bands, signatures, full sets, components.

1. Every text becomes the set of its word shingles, and that set 112 minima under universal
   hash functions. Texts with the same words are one class from here on; its least id
   stands for it. However many copies a text has, its links are looked for once.
2. Four minima make a band, so there are 28. Classes that agree in a band meet in a bucket.
   Two sets of similarity 0.8 agree in no band at all with probability 4e-7.
3. Every class is first compared with one other, the least class it meets in any bucket,
   then with the one that meets most others, then with the least of each bucket. What is
   linked by then is in one component and needs no comparison any more: a crowd of near
   copies is settled by about as many comparisons as it has classes. Only what is still in
   different components of one bucket is then compared each with each. No bucket is cut
   short.
4. A comparison looks at parities first: 1,024 bits, each telling whether an odd number of a
   set's shingles falls on it. Bits in which two sets differ are at most as many as shingles
   that only one of them has: an exact bound, which parts texts of some hundred words from
   others below 0.8 almost as well as the sets themselves. Then come signatures (one byte of
   each minimum; pairs of similarity 0.8 pass but for one in 1e6), and last the full sets of
   shingles, rebuilt from the whole texts.
5. Links make components by large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.llm.common import as_bytes, map_batches, plainly_named, stored
from garimpo.llm.components import components
from garimpo.operators.joins import join_to_unique

#: Words of a shingle, unless the caller names another number, and at most.
SHINGLE_WORDS, MOST_WORDS = 4, 16
#: Link from this many hundredths of the union.
PERCENT = 80
BANDS, ROWS = 28, 4
MINIMA = BANDS * ROWS
#: Equal signature bytes of 112 from which full sets are compared.
ALIKE = 70
_LONGS = MINIMA // 8
#: Bits on which the shingles of a set are counted modulo 2.
PARITY_BITS = 1024

#: Bits of the map of wanted ids: 2 MB, sent to every task that reads texts.
MAP_BITS = 1 << 24
_MAP_PAGE = 1 << 15  # bits of one bitmap of Spark's

# Bytes hashed at once, to bound the memory that a very long text takes.
_PIECE = 1 << 21

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_chance = np.random.default_rng(20240)


def _odd(n: int) -> np.ndarray:
    return _chance.integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


_BASE = int(_odd(1)[0])
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = _odd(256)
_PLACES = _odd(SHINGLE_WORDS)
_SHORT = _odd(SHINGLE_WORDS)
_FACTORS, _SHIFTS = _odd(MINIMA)[:, None], _odd(MINIMA)[:, None]
_BAND_PLACES, _BAND_SEEDS = _odd(ROWS), _odd(BANDS)
_PLACES = np.concatenate([_PLACES, _odd(MOST_WORDS - SHINGLE_WORDS)])
_SHORT = np.concatenate([_SHORT, _odd(MOST_WORDS - SHINGLE_WORDS)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in stretches that end at blanks."""
    while len(text) > _PIECE:
        cut = min((text.find(blank, _PIECE) for blank in (b" ", b"\n", b"\t")
                   if text.find(blank, _PIECE) >= 0), default=len(text))
        yield text[:cut]
        text = text[cut:]
    yield text


class WordHashes:
    """64-bit hashes of the words of a text: sums of letters times powers of a base."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def _of_piece(self, piece: bytes) -> np.ndarray:
        letters = np.frombuffer(piece, np.uint8)
        if len(letters) >= len(self.power):
            size = max(1 << 16, 2 * len(letters))
            self.power, self.inverse = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
        inside = np.zeros(len(letters) + 2, np.int8)
        inside[1:-1] = ~_BLANK[letters]
        edges = np.flatnonzero(np.diff(inside))
        first, after = edges[::2], edges[1::2]
        total = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(_LETTERS[letters] * self.power[: len(letters)], out=total[1:])
        return _mix((total[after] - total[first]) * self.inverse[first] + _U(1))

    def __call__(self, text: bytes) -> np.ndarray:
        if len(text) <= _PIECE:
            return self._of_piece(text)
        return np.concatenate([self._of_piece(piece) for piece in _pieces(text)])


def shingle_set(word_hashes: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of the shingles; of the whole sequence if it is shorter than one."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    if n < size:
        return _mix((word_hashes * _SHORT[:n]).sum(keepdims=True) + _U(n))
    last = n - size + 1
    mixed = sum(word_hashes[i : i + last] * _PLACES[i] for i in range(size))
    return np.unique(_mix(mixed))


def minima_of(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash function over the set."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        values = shingles[start : start + 2048] * _FACTORS
        values += _SHIFTS
        np.minimum(least, values.min(axis=1), out=least)
    return least >> _U(32)


def bands_of(minima: np.ndarray) -> np.ndarray:
    mixed = (minima.reshape(BANDS, ROWS) * _BAND_PLACES).sum(axis=1)
    return _mix(mixed + _BAND_SEEDS).view(np.int64)


def parity_of(shingles: np.ndarray) -> np.ndarray:
    """Which bits an odd number of the shingles falls on."""
    places = (shingles >> _U(40)) % _U(PARITY_BITS)
    odd = np.bincount(places.astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_SKETCH = (
    T.StructType()
    .add("n_shingles", "long")
    .add("words_key", "binary")
    .add("bands", T.ArrayType(T.LongType()))
    .add("signature", T.ArrayType(T.LongType()))
    .add("parity", T.ArrayType(T.LongType()))
)


def _make_sketch(size: int):
    hashes = WordHashes()

    def work(columns):
        out: dict[str, list] = {field.name: [] for field in _SKETCH}
        known: dict[bytes, tuple] = {}  # copies in a batch are worked out once
        for text in columns["_bytes"]:
            plain = b" ".join(text.lower().split())
            key = xxhash.xxh3_128_digest(plain)
            if key not in known:
                shingles = shingle_set(hashes(plain), size)
                bands = signature = parity = None
                if len(shingles):
                    minima = minima_of(shingles)
                    bands = bands_of(minima)
                    signature = minima.astype(np.uint8).view(np.int64)
                    parity = parity_of(shingles)
                known[key] = (len(shingles), key, bands, signature, parity)
            for column, value in zip(out.values(), known[key]):
                column.append(value)
        return out

    return work


def sketch(docs: DataFrame, text: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, size of the shingle set, key of the words, bands, signature and parity."""
    read = docs.select("doc_id", as_bytes(text).alias("_bytes"))
    return map_batches(read, lambda: _make_sketch(size), _SKETCH, ("doc_id",))


# Comparing --------------------------------------------------------------------------

_ONES = 0x0101010101010101


def _equal_bytes(a: Column, b: Column) -> Column:
    """How many of the 8 bytes of two long numbers are equal."""
    x = a.bitwiseXOR(b)
    for step in (4, 2, 1):  # the lowest bit of a byte: is any of its bits set?
        x = x.bitwiseOR(F.shiftrightunsigned(x, step))
    return 8 - F.bit_count(x.bitwiseAND(F.lit(_ONES)))


def _alike(a: str, b: str) -> Column:
    """May two sets be 0.8 similar, by their sizes, parities and signatures?"""
    equal = sum(
        (_equal_bytes(F.col(f"{a}_signature")[i], F.col(f"{b}_signature")[i])
         for i in range(_LONGS)),
        F.lit(0),
    )
    apart = sum(
        (F.bit_count(F.col(f"{a}_parity")[i].bitwiseXOR(F.col(f"{b}_parity")[i]))
         for i in range(PARITY_BITS // 64)),
        F.lit(0),
    )
    small = F.least(F.col(f"{a}_size"), F.col(f"{b}_size"))
    large = F.greatest(F.col(f"{a}_size"), F.col(f"{b}_size"))
    # With d shingles in one set only, the union is (sizes + d) / 2, the common part
    # (sizes - d) / 2.
    near = (100 + PERCENT) * apart <= (100 - PERCENT) * (small + large)
    return (100 * small >= PERCENT * large) & near & (equal >= ALIKE)


def _named(classes: DataFrame, side: str, *more: str) -> DataFrame:
    return classes.select(
        F.col("doc_id").alias(side), F.col("n_shingles").alias(f"{side}_size"),
        *(F.col(name).alias(f"{side}_{name}") for name in ("parity", "signature", *more)),
    )


def _shingles(text: bytes, size: int) -> set:
    found = text.lower().split()
    if len(found) < size:
        return {tuple(found)} if found else set()
    return set(zip(*(found[i:] for i in range(size))))


def _make_confirm(size: int):
    def confirm(columns: dict[str, list]) -> dict[str, list]:
        known: dict[int, set] = {}

        def shingles(number: int, text: bytes) -> set:
            if number not in known:
                if len(known) > 16:
                    known.clear()
                known[number] = _shingles(text, size)
            return known[number]

        linked = []
        for u, v, a, b in zip(columns["_u"], columns["_v"], columns["a_text"], columns["b_text"]):
            one, other = shingles(u, a), shingles(v, b)
            common = len(one & other)
            linked.append(100 * common >= PERCENT * (len(one) + len(other) - common))
        return {"linked": linked}

    return confirm


def _texts_of(docs: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """The texts of some documents.

    A map of a fixed number of bits, one set for the hash of each wanted id, is broadcast
    and lets hardly any other text into the shuffle of the exact join behind it.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS))
    page, place = F.floor(bit / _MAP_PAGE), bit % _MAP_PAGE
    pages = (
        ids.groupBy(page.alias("_page")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    )
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    is_set = F.call_function("shiftright", byte.cast("int"), (place % 8).cast("int")) % 2 == 1
    read = docs.select("doc_id", as_bytes(text).alias("_bytes"), page.alias("_page"))
    wanted = read.join(F.broadcast(pages), "_page").where(is_set).select("doc_id", "_bytes")
    return wanted.join(ids.hint("merge"), "doc_id", "left_semi")


def confirmed(
    pairs: DataFrame, docs: DataFrame, text: str = "text", size: int = SHINGLE_WORDS
) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""
    pairs = stored(pairs, "candidate-pairs")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    texts = _texts_of(docs, ids, text).dropDuplicates(["doc_id", "_bytes"])
    texts = stored(texts, "candidate-texts")
    one, other = (
        texts.select(F.col("doc_id").alias(side), F.col("_bytes").alias(f"{name}_text"))
        for side, name in (("u", "a"), ("v", "b"))
    )
    # Texts are large and pairs many at any size that matters: no side is ever broadcast.
    both = pairs.hint("merge").join(one, "u").hint("merge").join(other, "v")
    both = both.select(
        "u", "v", F.col("u").alias("_u"), F.col("v").alias("_v"), "a_text", "b_text"
    )
    schema = T.StructType().add("linked", "boolean")
    checked = map_batches(both, lambda: _make_confirm(size), schema, ("u", "v"))
    return checked.where("linked").select("u", "v")


def _against(buckets: DataFrame, classes: DataFrame, rank: Column, once: bool) -> DataFrame:
    """Candidate pairs of classes with the class of their buckets that ranks least.

    ``buckets`` has (bucket, doc_id, component, met); classes already in the component of
    the class they would be compared with are left alone. ``once``: one pair for each class.
    """
    one = buckets.groupBy("bucket").agg(
        F.min(F.struct(rank.alias("rank"), "doc_id", "component")).alias("one"),
        F.min("component").alias("low"), F.max("component").alias("high"),
    ).where("low <> high").select("bucket", "one.*")
    one = one.toDF("bucket", "_rank", "_one", "_component")
    met = join_to_unique(buckets, one, "bucket").where("component <> _component")
    if once:
        met = met.groupBy("doc_id").agg(F.min(F.struct("_rank", "_one")).alias("least"))
        met = met.select("doc_id", "least._one")
    pairs = met.select(
        F.least("doc_id", "_one").alias("a"), F.greatest("doc_id", "_one").alias("b")
    ).distinct()
    measured = join_to_unique(pairs, _named(classes, "a"), "a")
    measured = join_to_unique(measured, _named(classes, "b"), "b")
    return measured.where(_alike("a", "b")).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _across(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs of all classes of different components that share a bucket.

    Parities and signatures are compared inside the join, and a pair comes out of the first
    bucket only that it shares.
    """
    mixed = (
        buckets.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("bucket")
    )
    rows = join_to_unique(buckets, mixed, "bucket")
    sides = [
        rows.join(_named(classes, side, "bands"), rows.doc_id == F.col(side)).select(
            F.col("bucket").alias(f"{side}_bucket"),
            F.col("component").alias(f"{side}_component"),
            side, f"{side}_size", f"{side}_parity", f"{side}_signature", f"{side}_bands",
        )
        for side in ("a", "b")
    ]
    shared = F.get(F.array_intersect("a_bands", "b_bands"), F.lit(0)) == F.col("a_bucket")
    on = (
        (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a") < F.col("b"))
        & (F.col("a_component") != F.col("b_component")) & _alike("a", "b") & shared
    )
    return (
        sides[0].join(sides[1], on)
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
        .distinct()
    )


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after the links: components are joined as wholes."""
    ends = join_to_unique(links, labels.toDF("u", "_u"), "u")
    ends = join_to_unique(ends, labels.toDF("v", "_v"), "v")
    merged = components(ends.select(F.col("_u").alias("u"), F.col("_v").alias("v")))
    merged = merged.toDF("component", "_joined")
    out = join_to_unique(labels, merged, "component", "left")
    return out.select("node", F.coalesce("_joined", "component").alias("component"))


def near_duplicates(
    docs: DataFrame, text: str = "text", size: int = SHINGLE_WORDS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Words are parted by blanks, A-Z lower-cased; a set is the distinct shingles of
    ``size`` words, of fewer words the whole sequence. A missing or empty text, or one without words,
    has the empty set and is linked with nothing; a row without id keeps to itself:
    component_id is missing and kept true. Rows with one id are one document in links. Equal
    texts are in one component; other columns are left out; an empty table gives an empty one.
    """
    sketched = stored(sketch(docs, text, size), "sketches")
    usable = sketched.where("doc_id is not null and n_shingles > 0")
    named = usable.groupBy("words_key").agg(F.min("doc_id").alias("class_id"))
    members = stored(
        join_to_unique(usable.select("doc_id", "words_key"), named, "words_key"), "members"
    )
    heads = members.where("doc_id = class_id").select("doc_id", "words_key").distinct()
    classes = stored(
        sketched.join(heads, ["doc_id", "words_key"])
        .dropDuplicates(["doc_id", "words_key"])
        .drop("words_key"),
        "classes",
    )
    rows = classes.select("doc_id", F.explode("bands").alias("bucket")).distinct()
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    # Buckets of one class are most of all; they are gone from here on.
    buckets = stored(join_to_unique(rows, shared, "bucket"), "buckets")

    # ``met``: with how many classes one shares a bucket, each bucket counted.
    nodes = buckets.groupBy(F.col("doc_id").alias("node")).agg(F.sum("n").alias("met"))
    nodes = stored(nodes, "nodes")
    buckets = buckets.drop("n")
    labels = nodes.select("node", F.col("node").alias("component"))
    least, central = F.col("doc_id"), -F.col("met")
    for candidates in (
        lambda now: _against(now, classes, least, True),
        lambda now: _against(now, classes, central, True),
        lambda now: _against(now, classes, least, False),
        lambda now: _across(now, classes),
    ):
        placed = labels.join(nodes, "node").withColumnRenamed("node", "doc_id")
        now = join_to_unique(buckets, placed, "doc_id")
        more = () if size == SHINGLE_WORDS else (size,)
        links = stored(confirmed(candidates(now), docs, text, *more), "links")
        if not links.isEmpty():
            labels = stored(_relabelled(labels, links), "labels")

    of_class = labels.select(F.col("node").alias("class_id"), "component")
    placed = join_to_unique(members, of_class, "class_id", "left").select(
        "doc_id", "words_key", F.coalesce("component", "class_id").alias("component_id")
    ).distinct()
    out = sketched.select("doc_id", "n_shingles", "words_key").join(
        placed, ["doc_id", "words_key"], "left"
    )
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def keep_one(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each group of near-duplicates, with its columns, whatever those are.

    Rows without an id stay. Of rows with one id the one with the least text stays, NULL
    first; equal texts are told apart by a hash of the row. An empty table gives an empty one.
    """
    judged = near_duplicates(docs, size=size).where("kept and doc_id is not null")
    ids = judged.select("doc_id").distinct()
    rows, names = plainly_named(docs)
    number, text = names["doc_id"], names["text"]
    whole = F.struct(*rows.columns)
    hashed = [f.name for f in rows.schema if not isinstance(f.dataType, T.MapType)]
    one = (
        rows.where(F.col(number).isNotNull())
        .join(ids, F.col(number) == ids["doc_id"], "left_semi")
        .groupBy(F.col(number).alias("_id"))
        .agg(F.min_by(whole, F.struct(text, F.xxhash64(*hashed))).alias("_row"))
        .select("_row.*")
    )
    every = one.unionAll(rows.where(F.col(number).isNull()))
    return every.select(*[F.col(new).alias(old) for old, new in names.items()])
