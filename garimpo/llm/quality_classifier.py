"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees are grown on the statistics of a bounded sample of labelled documents; every
path from a root to a node is a rule, a conjunction of bounds on statistics; a logistic
regression with a lasso penalty over all rules keeps the few that matter; these become one
Spark column expression, so scoring runs where the rows are, without Python.

Only statistics of the text enter: no id, label, language or source.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.llm.common import (
    as_bytes,
    code_points,
    doc_crc,
    map_batches,
    plainly_named,
    stored,
    words,
)

#: Labelled documents that the model is fitted on, at most; those of least id hash.
SAMPLE_ROWS = 12_000
TREES, DEPTH, BINS, LEAST_IN_NODE, RATE = 30, 3, 32, 20, 0.3
#: Weight of the lasso penalty against the mean log loss.
PENALTY = 5e-4
STEPS = 300

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"#*$%&@^~_=+"
_FRAMES = b"|<>[]{}\\/"
_STOPS = b".,;:"

STATISTICS = (
    "words_log", "mean_word", "longest_word", "upper", "digits", "marks", "frames",
    "exclaims", "stops", "line_words", "doubled_lines", "distinct_words", "same_as_last",
    "top_word", "repeated_triples",
)
_SCHEMA = T.StructType([T.StructField(name, T.DoubleType(), False) for name in STATISTICS])


def statistics_of(text: bytes) -> tuple[float, ...]:
    """The statistics of one text, in the order of ``STATISTICS``; all 0 without words."""
    found = words(text)
    n = len(found)
    if not n:
        return (0.0,) * len(STATISTICS)
    size = len(text)

    def share(letters: bytes, of: int = n) -> float:
        return (size - len(text.translate(None, letters))) / of

    counts = Counter(found)
    triples = list(zip(found, found[1:], found[2:]))
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    chars = code_points(text) - (size - sum(map(len, found)))
    return (
        float(np.log2(n + 1)),
        chars / n,
        float(min(max(map(len, counts)), 1000)),
        share(_UPPER),
        share(_DIGITS),
        share(_MARKS),
        share(_FRAMES),
        text.count(b"!") / n,
        share(_STOPS),
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        len(counts) / n,
        sum(map(eq, found, found[1:])) / n,
        max(counts.values()) / n,
        1 - len(set(triples)) / max(1, len(triples)),
    )


def _measure(columns: dict[str, list]) -> dict[str, list]:
    rows = [statistics_of(text) for text in columns["_bytes"]]
    return {name: [row[i] for row in rows] for i, name in enumerate(STATISTICS)}


def with_statistics(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep`` columns and the statistics of every whole text."""
    read = docs.select(*keep, as_bytes(text).alias("_bytes"))
    return map_batches(read, lambda: _measure, _SCHEMA, keep)


# Fitting ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Bound:
    """``statistic <= limit``, or ``> limit`` if ``above``."""

    statistic: int
    limit: float
    above: bool


Rule = tuple[Bound, ...]


@dataclass
class RuleModel:
    """Log odds: ``intercept`` and the weights of the rules that hold."""

    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def log_odds(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for bound in rule:
                value = F.col(STATISTICS[bound.statistic])
                holds &= value > bound.limit if bound.above else value <= bound.limit
            total += F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return total

    def score(self) -> Column:
        """Probability of label 1."""
        return 1 / (1 + F.exp(-self.log_odds()))


def _cuts(values: np.ndarray) -> list[np.ndarray]:
    """Candidate limits of every statistic: its distinct quantiles."""
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(column, quantiles, method="lower")) for column in values.T]


def _best_split(bins, cuts, rows, gradient, curvature):
    """(gain, statistic, bin) of the best split of a node; Newton gain."""
    best = (1e-6, -1, -1)
    g, h = gradient[rows], curvature[rows]
    whole_g, whole_h = g.sum(), h.sum()
    for statistic, limits in enumerate(cuts):
        if not len(limits):
            continue
        at = bins[rows, statistic]
        size = len(limits) + 1
        left_g = np.cumsum(np.bincount(at, g, size))[:-1]
        left_h = np.cumsum(np.bincount(at, h, size))[:-1]
        left_n = np.cumsum(np.bincount(at, minlength=size))[:-1]
        gain = left_g**2 / (left_h + 1) + (whole_g - left_g) ** 2 / (whole_h - left_h + 1)
        gain -= whole_g**2 / (whole_h + 1)
        gain[(left_n < LEAST_IN_NODE) | (len(rows) - left_n < LEAST_IN_NODE)] = -1
        place = int(np.argmax(gain))
        if gain[place] > best[0]:
            best = (float(gain[place]), statistic, place)
    return best


def tree_rules(values: np.ndarray, labels: np.ndarray) -> list[Rule]:
    """The paths to all nodes of boosted trees, each rule once."""
    cuts = _cuts(values)
    bins = np.stack(
        [np.searchsorted(limits, column) for limits, column in zip(cuts, values.T)], 1
    )
    chance = np.random.default_rng(7)
    log_odds = np.zeros(len(labels))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-log_odds))
        gradient, curvature = p - labels, p * (1 - p)
        drawn = chance.random(len(labels)) < 0.5
        open_nodes = [((), np.arange(len(labels)))]
        for depth in range(DEPTH + 1):
            deeper = []
            for rule, rows in open_nodes:
                if rule:
                    found.setdefault(tuple(sorted(rule, key=lambda b: (b.statistic, b.above))))
                sampled = rows[drawn[rows]]
                split = (0.0, -1, -1)
                if depth < DEPTH and len(sampled) >= 2 * LEAST_IN_NODE:
                    split = _best_split(bins, cuts, sampled, gradient, curvature)
                if split[1] < 0:
                    step = -gradient[rows].sum() / (curvature[rows].sum() + 1)
                    log_odds[rows] += RATE * np.clip(step, -4, 4)
                    continue
                _, statistic, place = split
                limit = float(cuts[statistic][place])
                low = bins[rows, statistic] <= place
                deeper += [
                    ((*rule, Bound(statistic, limit, False)), rows[low]),
                    ((*rule, Bound(statistic, limit, True)), rows[~low]),
                ]
            open_nodes = deeper
    return list(found)


def rule_matrix(rules: list[Rule], values: np.ndarray) -> np.ndarray:
    out = np.ones((len(values), len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for bound in rule:
            holds = values[:, bound.statistic] > bound.limit
            out[:, j] *= holds if bound.above else ~holds
    return out


def lasso_logistic(x: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps."""
    n, width = x.shape
    # One kind of number throughout: mixed kinds would copy the matrix at every product.
    labels = labels.astype(np.float32)
    back = np.ascontiguousarray(x.T)
    rate = float(np.clip(labels.mean(), 0.5 / n, 1 - 0.5 / n))
    point = np.zeros(width + 1, np.float32)
    point[0] = np.log(rate / (1 - rate))
    # Largest eigenvalue of the curvature, by power iteration, bounds the step.
    v = np.ones(width + 1, np.float32)
    for _ in range(15):
        u = x @ v[1:] + v[0]
        v = np.concatenate([[u.sum()], back @ u]).astype(np.float32)
        v /= np.linalg.norm(v) or 1
    top = float(np.linalg.norm(x @ v[1:] + v[0])) ** 2 / n
    step = np.float32(1 / (0.25 * 1.1 * top + 1e-9))
    ahead, momentum = point, 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(x @ ahead[1:] + ahead[0]))) - labels
        slope = np.concatenate([[error.mean()], back @ error / n]).astype(np.float32)
        last, point = point, ahead - step * slope
        shrunk = np.maximum(np.abs(point[1:]) - step * np.float32(PENALTY), 0)
        point[1:] = np.sign(point[1:]) * shrunk
        if np.abs(point - last).max() < 1e-5:
            break
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = point + np.float32((momentum - 1) / faster) * (point - last)
        momentum = faster
    return float(point[0]), point[1:].astype(float)


def fit(values: np.ndarray, labels: np.ndarray) -> RuleModel:
    """Model for the given statistics and labels (0 or 1).

    Without labels every score is one half; with labels of one kind, a constant beside it.
    """
    if not len(labels):
        return RuleModel()
    if labels.min() == labels.max():
        n = len(labels)
        return RuleModel(float(np.log((n * labels[0] + 0.5) / (n * (1 - labels[0]) + 0.5))))
    rules = tree_rules(values, labels.astype(float))
    if not rules:
        rate = labels.mean()
        return RuleModel(float(np.log(rate / (1 - rate))))
    intercept, weights = lasso_logistic(rule_matrix(rules, values), labels.astype(float))
    return RuleModel(intercept, [(r, float(w)) for r, w in zip(rules, weights) if w])


# On tables --------------------------------------------------------------------------


def held_out() -> Column:
    """Documents whose labels are never learnt from; a missing id counts as one."""
    return F.coalesce(doc_crc() % 3 == 1, F.lit(True))


def label_sample(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` (doc_id, quality) of documents that may be learnt from.

    The ids of least hash are taken, whatever their label. Labels other than 0 and 1 do not
    count; of several for a document the least does.
    """
    return (
        labels.where(~held_out() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


def _fit_rows(measured: DataFrame, sample: DataFrame) -> RuleModel:
    # The sample has SAMPLE_ROWS rows at most, so it may be broadcast and its statistics
    # collected. A document that is there twice is learnt from twice at most.
    rows = (
        measured.join(F.broadcast(sample), "doc_id")
        .select("doc_id", "quality", *STATISTICS)
        .dropDuplicates(["doc_id", "quality", *STATISTICS])
        .orderBy("doc_id", *STATISTICS)
        .limit(2 * SAMPLE_ROWS)
        .toPandas()
    )
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["quality"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A missing or empty text has all statistics 0 and the score of that; equal rows score
    alike; other columns are left out; an empty table gives an empty one; without usable
    labels every score is one half.
    """
    measured = stored(with_statistics(docs.select("doc_id", "text"), ("doc_id",)), "statistics")
    model = _fit_rows(measured, label_sample(labels))
    scored = measured.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(
    docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None
) -> DataFrame:
    """The rows predicted good, with exactly their columns, whatever those are.

    ``learn_from`` (doc_id, text) has the texts of labelled rows, ``docs`` if not given.
    Documents that an earlier filter has passed hold too few bad ones to learn from. A
    missing or empty text is scored as in :func:`classify`, equal rows alike; without usable
    labels every row stays; an empty table gives an empty one.
    """
    sample = label_sample(labels)
    texts = (docs if learn_from is None else learn_from).select("doc_id", "text")
    learnt = texts.join(F.broadcast(sample.select("doc_id")), "doc_id")
    model = _fit_rows(with_statistics(learnt, ("doc_id",)), sample)
    rows, names = plainly_named(docs)
    text = names["text"]

    def make():
        return lambda columns: _measure(
            {"_bytes": [(value or "").encode() for value in columns[text]]}
        )

    measured = map_batches(rows, make, _SCHEMA, rows.columns, also=[text])
    good = measured.where(model.score() >= 0.5)
    return good.select(*[F.col(new).alias(old) for old, new in names.items()])
