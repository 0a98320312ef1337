"""URL filter: allow and block rules first, boosted trees on lexical features for the rest.

The URLs that a rule decides are the labelled ones. Trees are trained on a bounded sample of
them, on what a URL looks like: lengths, depth, shares of digits and marks, entropy of its
letters, parameters, and how its suffix fares among labelled URLs. Everything is a column
expression, a grouped aggregation or an ML stage of the DataFrame API.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.llm.common import stored
from garimpo.operators.joins import join_to_unique

#: Labelled URLs that the trees are trained on, at most; those of least hash.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LEAST_IN_NODE, SEED = 12, 3, 50, 11
#: Labelled URLs that a suffix is credited with beforehand, blocked as often as all are.
PRIOR = 20
#: Probability from which the trees block: a URL that no rule decides goes only if it looks
#: much more like blocked ones than like allowed ones.
BLOCK_FROM = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Holds for ``host`` and all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

FEATURES = (
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "longest_part",
    "digit_share", "mark_share", "entropy", "parameters", "query_length", "has_fragment",
    "suffix_rate",
)


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return _part(url, 2)


def _fits(rule: Rule) -> Column:
    host = F.col("host")
    of_host = (host == rule.host) | host.endswith("." + rule.host)
    return of_host & F.col("path").startswith(rule.path)


def by_rules(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; NULL if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: len(rule.name)):
        name = F.when(_fits(rule), rule.name).otherwise(name)
        verdict = F.when(_fits(rule), rule.verdict).otherwise(verdict)
    return name, verdict


def _count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per letter: over the distinct letters, how often each is there."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")

    def share(letter: Column) -> Column:
        return (size - F.length(F.replace(text, letter, F.lit("")))) / size

    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(letters, F.lit(0.0), lambda sum_, c: sum_ - share(c) * F.log2(share(c)))


def _longest(parts: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0))


def with_features(rows: DataFrame) -> DataFrame:
    """The lexical features of ``_url``, but for those of its suffix, and the suffix."""
    url, host, path = F.col("_url"), F.col("host"), F.col("path")
    size = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return rows.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_length": F.length(path).cast("double"),
            "host_depth": _count_of(host, r"\."),
            "path_depth": _count_of(path, "/[^/]"),
            "longest_part": _longest(F.split(host, r"\.")).cast("double"),
            "digit_share": _count_of(url, "[0-9]") / size,
            "mark_share": _count_of(url, "[^0-9A-Za-z]") / size,
            "entropy": _entropy(url),
            "parameters": _count_of(query, "="),
            "query_length": F.length(query).cast("double"),
            "has_fragment": F.contains(url, F.lit("#")).cast("double"),
            "suffix": F.regexp_extract(host, r"([^.]*)$", 1),
        }
    )


def with_suffixes(rows: DataFrame) -> DataFrame:
    """Add the share of blocked URLs among the labelled ones of the same suffix."""
    blocked, labelled = F.count_if(F.col("verdict") == "block"), F.count("verdict")
    overall = rows.agg((blocked / F.greatest(labelled, F.lit(1))).alias("rate")).scalar()
    suffixes = rows.groupBy("suffix").agg(
        ((blocked + PRIOR * F.first(overall)) / (labelled + PRIOR)).alias("suffix_rate")
    )
    return join_to_unique(rows, suffixes, "suffix")


def judge(
    pages: DataFrame, rules: Sequence[Rule] = RULES, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    A missing URL, or one without ``://``, has an empty host and path, no rule, and the
    verdict of the trees for what it looks like. Equal URLs get equal verdicts; missing ids
    stay missing; other columns are left out; an empty table gives an empty one. Unless
    rules allow some URLs and block others there is nothing to learn: the rest is allowed.
    """
    link = F.coalesce(F.col(url), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), link.alias("_url"))
    rows = rows.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    name, verdict = by_rules(rules)
    rows = rows.withColumns({"rule": name, "verdict": verdict})
    measured = stored(with_suffixes(with_features(rows)), "url-features")
    sample = stored(
        measured.where("verdict is not null")
        .orderBy(F.xxhash64("_url"), "_url")
        .limit(SAMPLE_ROWS)
        .select((F.col("verdict") == "block").cast("double").alias("label"), *FEATURES),
        "url-sample",
    )
    kinds = sample.agg(F.count_distinct("label")).first()[0]
    out = measured.withColumn("learnt", F.lit("allow"))
    if kinds == 2:
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        trees = GBTClassifier(
            maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_IN_NODE, seed=SEED,
            labelCol="label",
        )
        scored = trees.fit(assembler.transform(sample)).transform(assembler.transform(measured))
        blocked = vector_to_array("probability")[1] >= BLOCK_FROM
        out = scored.withColumn("learnt", F.when(blocked, "block").otherwise("allow"))
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "learnt").alias("verdict")
    )
