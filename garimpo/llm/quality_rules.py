"""Quality rules whose thresholds come from quantile sketches per language and source.

Every document has a few counts, and every rule is a whole-number ratio of two of them. A
sketch of a ratio is a histogram whose bins are the ratio's leading bits (exact up to 63,
then 32 bins to each doubling, so a quantile is at most a 32nd too low). Sketches merge by
adding counts, whatever the order: they are sums in a grouped aggregation, combined before
the shuffle. A source's own sketch is used when it holds enough documents; else that of
its language, else that of all, each merged from the finer ones.

A document goes if one of its ratios lies beyond ``q75 + reach * max(q75 - q25, slack)``
(or, for ratios that must not be small, below the same on the other side) of its group.
``slack`` is the least spread that a rule takes for granted: in a clean source most ratios
are 0, and that must not make a single symbol an outlier.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.llm.common import (
    as_bytes,
    code_points,
    map_batches,
    plainly_named,
    stored,
    words,
)

SYMBOLS = b"#*$%&|<>"
WINDOW_WORDS = 5
#: Documents that a sketch must hold for its quantiles to count.
ENOUGH = 100


@dataclass(frozen=True)
class Rule:
    """``1000 * part / whole``, rounded down, must not be an outlier of its group."""

    name: str
    part: str
    whole: str
    reach: int
    slack: int
    high: bool = True


RULES = (
    Rule("symbols", "n_symbols", "n_words", 6, 20),
    Rule("repeats", "n_repeat_words", "n_words", 4, 45),
    Rule("dup_lines", "n_dup_lines", "n_words", 6, 12),
    Rule("long_words", "word_chars", "n_words", 4, 500),
    Rule("short_words", "word_chars", "n_words", 4, 500, high=False),
)

_COUNTS = T.StructType()
for _name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
    _COUNTS = _COUNTS.add(_name, "long")


def repeated_words(text: list[bytes], size: int = WINDOW_WORDS) -> int:
    """Words that lie in a window found twice or more in the text, the first included."""
    windows = list(zip(*(text[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    seen: set[tuple[bytes, ...]] = set()
    twice: set[tuple[bytes, ...]] = set()
    for window in windows:
        (twice if window in seen else seen).add(window)
    covered = reach = 0
    for place, window in enumerate(windows):
        if window in twice:
            covered += place + size - max(place, reach)
            reach = place + size
    return covered


def counts_of(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    found = words(text)
    blanks = len(text) - sum(map(len, found))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = text.split(b"\n")
    doubles = 0
    if len(set(lines)) < len(lines):
        filled = [line for line in lines if line.split(None, 1)]
        doubles = len(filled) - len(set(filled))
    return len(found), code_points(text) - blanks, symbols, doubles, repeated_words(found)


def _count(columns: dict[str, list]) -> dict[str, list]:
    rows = [counts_of(text) for text in columns["_bytes"]]
    return {field.name: [row[i] for row in rows] for i, field in enumerate(_COUNTS)}


def with_counts(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep`` columns and the counts of every whole text."""
    read = docs.select(*keep, as_bytes(text).alias("_bytes"))
    return map_batches(read, lambda: _count, _COUNTS, keep)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratio(rule: Rule) -> Column:
    """The rule's ratio; 0 without words."""
    return F.expr(f"(1000 * {rule.part}) div greatest({rule.whole}, 1)")


def bin_floor(value: Column) -> Column:
    """Least value of the bin that a ratio falls into: its six leading bits."""
    step = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, step), step)


def sketches(counted: DataFrame, group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Histogram of every rule's ratio over documents that pass the base rules.

    One row per level, group, rule and bin: at most a few hundred bins to a rule and group.
    The level is 2 for a language and source, 1 for a language, 0 for all.
    """
    lang, source = (F.col(name) for name in group)
    bins = F.array(
        *[
            F.struct(F.lit(rule.name).alias("rule"), bin_floor(ratio(rule)).alias("bin"))
            for rule in RULES
        ]
    )
    finest = (
        counted.where(~base_failed())
        .select(lang.alias("lang"), source.alias("source"), F.inline(bins))
        .groupBy("lang", "source", "rule", "bin")
        .agg(F.count("*").alias("n"))
    )
    none = F.lit(None).cast("string")
    by_lang = finest.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n"))
    of_all = finest.groupBy("rule", "bin").agg(F.sum("n").alias("n"))
    columns = ("level", "lang", "source", "rule", "bin", "n")
    return (
        finest.withColumn("level", F.lit(2)).select(*columns)
        .unionAll(by_lang.withColumns({"level": F.lit(1), "source": none}).select(*columns))
        .unionAll(
            of_all.withColumns({"level": F.lit(0), "lang": none, "source": none}).select(*columns)
        )
    )


def thresholds(sketch: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """One row per level and group with a sketch large enough: the limits of all rules."""
    group = ("level", "lang", "source", "rule")
    below = Window.partitionBy(*group).orderBy("bin")
    ranked = sketch.withColumns(
        {"upto": F.sum("n").over(below), "total": F.sum("n").over(Window.partitionBy(*group))}
    )

    def quantile(quarter: int) -> Column:
        return F.min(F.when(4 * F.col("upto") >= quarter * F.col("total"), F.col("bin")))

    quartiles = ranked.where(F.col("total") >= enough).groupBy(*group).agg(
        quantile(1).alias("q25"), quantile(3).alias("q75")
    )

    def limit(rule: Rule) -> Column:
        spread = rule.reach * F.greatest(F.col("q75") - F.col("q25"), F.lit(rule.slack))
        edge = F.col("q75") + spread if rule.high else F.col("q25") - spread
        return F.max(F.when(F.col("rule") == rule.name, edge)).alias(f"limit_{rule.name}")

    return quartiles.groupBy("level", "lang", "source").agg(*[limit(rule) for rule in RULES])


def with_verdict(
    counted: DataFrame, limits: DataFrame, group: tuple[str, str] = ("lang", "source")
) -> DataFrame:
    """``counted`` with ``base_failed`` and ``kept``.

    Joins the limits of each row's source, of its language and of all: Spark measures the
    limits and broadcasts them while they are small, and splits hot sources otherwise.
    Missing languages and sources form groups of their own.
    """
    names = [f"limit_{rule.name}" for rule in RULES]
    lang, source = group
    out = counted
    for level in (2, 1, 0):
        part = limits.where(F.col("level") == level).select(
            F.col("lang").alias("_lang"), F.col("source").alias("_source"),
            *[F.col(name).alias(f"_{level}_{name}") for name in names],
        )
        if level == 0:
            # One row, or none: a scalar subquery for each rule instead of a join.
            fallback = {
                f"_0_{name}": part.agg(F.max(f"_0_{name}")).scalar() for name in names
            }
            out = out.withColumns(fallback)
            continue
        on = F.col(lang).eqNullSafe(F.col("_lang"))
        if level == 2:
            on &= F.col(source).eqNullSafe(F.col("_source"))
        out = out.join(part, on, "left").drop("_lang", "_source")
    outlier = F.lit(False)
    for rule, name in zip(RULES, names):
        edge = F.coalesce(*[F.col(f"_{level}_{name}") for level in (2, 1, 0)])
        beyond = ratio(rule) > edge if rule.high else ratio(rule) < edge
        outlier = outlier | F.coalesce(beyond, F.lit(False))
    failed = base_failed()
    out = out.withColumns({"base_failed": failed, "kept": ~failed & ~outlier})
    return out.drop(*[f"_{level}_{name}" for level in (2, 1, 0) for name in names])


def judge(docs: DataFrame, purpose: str = "quality-rules") -> DataFrame:
    """doc_id, lang, source, counts, ``base_failed`` and ``kept`` of every document.

    A missing or empty text has no words and fails; missing languages and sources are
    groups like any other; equal rows are judged alike; other columns are left out; an
    empty table gives an empty one. The counts are written once: thresholds need them all.
    """
    counted = stored(with_counts(docs, ("doc_id", "lang", "source")), purpose)
    return with_verdict(counted, stored(thresholds(sketches(counted)), f"{purpose}-limits"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that :func:`judge` keeps, with exactly their columns, whatever those are.

    As there, a missing or empty text fails, missing languages and sources are groups of
    their own, equal rows are judged alike and an empty table gives an empty one. Rows and
    counts are written once, from one pass over the texts.
    """
    rows, names = plainly_named(docs)
    text, lang, source = (names[name] for name in ("text", "lang", "source"))

    def make():
        return lambda columns: _count(
            {"_bytes": [(value or "").encode() for value in columns[text]]}
        )

    counted = stored(
        map_batches(rows, make, _COUNTS, rows.columns, also=[text]), "quality-counts"
    )
    limits = stored(thresholds(sketches(counted, (lang, source))), "quality-limits")
    judged = with_verdict(counted, limits, (lang, source))
    return judged.where("kept").select(*[F.col(new).alias(old) for old, new in names.items()])
