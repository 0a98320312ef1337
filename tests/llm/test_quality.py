"""Quality rules against plain Python, the classifier by held-out accuracy."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from garimpo.llm import quality_classifier as qc
from garimpo.llm import quality_rules as qr
from garimpo.llm import queries
from garimpo.llm.common import table

from .conftest import SF


def _plain_counts(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, doubles = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubles += line in seen
            seen.add(line)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(found), sum(map(len, found)), symbols, doubles, len(covered)


def _counts(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words


def test_counts_of_the_query(spark, documents):
    rows = {r.doc_id: r for r in queries.op3_quality_rules(spark, SF).collect()}
    assert len(rows) == len(documents)
    for number, text in documents:
        n, _, _, _, repeated = wanted = _plain_counts(text)
        assert _counts(rows[number]) == wanted
        failed = n < 10 or 100 * repeated > 20 * n
        assert rows[number].base_failed == failed
        assert not (failed and rows[number].kept)


def _plain_bin(value):
    step = max(0, len(bin(value)) - 2 - 6)
    return value >> step << step


def _plain_verdicts(rows, enough):
    """The thresholds worked out over lists of ratios."""

    def ratio(rule, row):
        return 1000 * row[rule.part] // max(1, row[rule.whole])

    fine = [r for r in rows if not r["base_failed"]]
    limits = {}
    for level in (2, 1, 0):
        groups = {}
        for row in fine:
            groups.setdefault((row["lang"], row["source"])[:level], []).append(row)
        for key, members in groups.items():
            if len(members) < enough:
                continue
            for rule in qr.RULES:
                values = sorted(_plain_bin(ratio(rule, m)) for m in members)
                q25, q75 = (values[math.ceil(len(values) * q / 4) - 1] for q in (1, 3))
                spread = rule.reach * max(q75 - q25, rule.slack)
                limits[key, rule] = q75 + spread if rule.high else q25 - spread

    def good(row):
        for rule in qr.RULES:
            keys = [(row["lang"], row["source"])[:level] for level in (2, 1, 0)]
            edge = next((limits[k, rule] for k in keys if (k, rule) in limits), None)
            if edge is not None:
                value = ratio(rule, row)
                if value > edge if rule.high else value < edge:
                    return False
        return not row["base_failed"]

    return [good(row) for row in rows]


@pytest.mark.parametrize("enough", [3, 20, 10_000])
def test_thresholds(spark, enough):
    counted = qr.with_counts(table(spark, SF, "documents"), ("doc_id", "lang", "source"))
    counted = counted.withColumn("source", F.when(F.col("source") != "src1", F.col("source")))
    limits = qr.thresholds(qr.sketches(counted), enough)
    rows = [r.asDict() for r in qr.with_verdict(counted, limits).collect()]
    assert [r["kept"] for r in rows] == _plain_verdicts(rows, enough)


def test_sketches_merge(spark):
    """Sketches of two halves add up to the sketch of the whole."""
    counted = qr.with_counts(table(spark, SF, "documents"), ("doc_id", "lang", "source")).cache()
    key = ["level", "lang", "source", "rule", "bin"]
    halves = qr.sketches(counted.where("doc_id % 2 = 0")).unionAll(
        qr.sketches(counted.where("doc_id % 2 = 1"))
    )
    added = halves.groupBy(*key).agg(F.sum("n").alias("n"))
    whole = qr.sketches(counted)
    assert added.exceptAll(whole).isEmpty() and whole.exceptAll(added).isEmpty()


def test_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op3_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    clean = rows.where("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("int")))
    junk = rows.where("quality = 0").agg(F.avg((~F.col("kept")).cast("int")))
    assert clean.first()[0] >= 0.98 and junk.first()[0] >= 0.9


def test_ugly_rows_of_the_rules(spark, ugly, empty):
    judged = qr.judge(ugly).collect()
    assert len(judged) == ugly.count()
    by_id = {r.doc_id: r for r in judged if r.doc_id is not None}
    assert all(not by_id[i].kept and by_id[i].base_failed for i in (1, 2, 3, 4, 5))
    assert _counts(by_id[1]) == (0, 0, 0, 0, 0)
    assert _counts(by_id[7])[0] == 60_000
    kept = qr.keep_good(ugly)
    assert kept.schema == ugly.schema
    assert kept.where("doc_id = 9").count() == 2
    assert qr.judge(empty).count() == 0 and qr.keep_good(empty).columns == empty.columns


# Classifier -------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_quality_classifier(spark, sf)
    assert rows.count() == table(spark, sf, "documents").count()
    judged = rows.join(table(spark, sf, "labels"), "doc_id").collect()
    for row in judged:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.5)
    held = [r for r in judged if r.held_out]
    for label in (0, 1):
        own = [r.predicted == label for r in held if r.quality == label]
        assert sum(own) >= 0.9 * len(own)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    other = labels.withColumn(
        "quality", F.when(qc.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    first = qc.classify(docs, labels).orderBy("doc_id").collect()
    assert first == qc.classify(docs, other).orderBy("doc_id").collect()


def test_expression_equals_matrix(spark):
    chance = np.random.default_rng(5)
    values = chance.normal(size=(600, len(qc.STATISTICS)))
    labels = ((values[:, 0] > 0) & (values[:, 3] < 0.5)).astype(float)
    model = qc.fit(values, labels)
    assert 0 < len(model.rules)
    rules = [rule for rule, _ in model.rules]
    weights = np.array([weight for _, weight in model.rules])
    odds = model.intercept + qc.rule_matrix(rules, values) @ weights
    assert ((odds > 0) == (labels == 1)).mean() > 0.97
    frame = spark.createDataFrame(values.tolist(), list(qc.STATISTICS))
    scores = [r.score for r in frame.select(model.score().alias("score")).collect()]
    assert np.allclose(scores, 1 / (1 + np.exp(-odds)))


def test_lasso_drops_rules(monkeypatch):
    monkeypatch.setattr(qc, "PENALTY", 0.03)
    chance = np.random.default_rng(2)
    x = (chance.random((500, 40)) < 0.5).astype(np.float32)
    intercept, weights = qc.lasso_logistic(x, x[:, 7])
    assert np.argmax(np.abs(weights)) == 7 and (weights == 0).sum() > 20


def test_labels_of_one_kind_or_none():
    values = np.zeros((30, len(qc.STATISTICS)))
    assert qc.fit(values, np.ones(30)).intercept > 0
    assert qc.fit(values, np.zeros(30)).intercept < 0
    assert qc.fit(values[:0], np.zeros(0)).intercept == 0
    mixed = qc.fit(values, np.arange(30) % 2.0)
    assert abs(mixed.intercept) < 1e-6 and not mixed.rules


def test_ugly_rows_of_the_classifier(spark, ugly, empty):
    labels = spark.createDataFrame(
        [(i, None if i == 4 else i % 2, None) for i in range(12)],
        "doc_id bigint, quality int, toxic int",
    )
    rows = qc.classify(ugly, labels).collect()
    assert len(rows) == ugly.count()
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert qc.keep_good(ugly, labels).schema == ugly.schema
    none = labels.limit(0)
    assert {r.score for r in qc.classify(ugly, none).collect()} == {0.5}
    assert qc.classify(empty, labels).count() == 0


def test_filtered_documents_are_judged_by_the_whole_corpus(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    passed = qr.keep_good(docs)
    good = qc.classify(docs, labels).where("predicted = 1").select("doc_id")
    kept = qc.keep_good(passed, labels, docs)
    assert kept.columns == docs.columns
    wanted = passed.join(good, "doc_id", "left_semi")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in wanted.collect())
    # Documents of one label only: nothing to learn from among themselves.
    bad = docs.join(labels.where("quality = 0"), "doc_id", "left_semi")
    assert qc.keep_good(bad, labels, docs).count() <= 0.1 * bad.count()


def test_label_sample_is_bounded(spark):
    labels = duckdb.sql(f"SELECT * FROM '{SF}/labels.parquet'").df()
    sample = qc.label_sample(spark.createDataFrame(labels), 5).collect()
    assert len(sample) == 5
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in sample)
