"""From raw documents to packed sequences, in four stages.

Each stage takes (spark, documents, folder of the tables) and returns a DataFrame; ``run``
writes what a stage returns and reads it again as the documents of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from garimpo.llm import near_dedup, packing, quality_classifier, quality_rules
from garimpo.llm.common import stored, table
from garimpo.llm.queries import word_vocabulary

#: Words of a shingle of the near-duplicates; the query op2_near_dedup has its own number.
SHINGLE_WORDS = 5


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their group's thresholds.

    Every stage takes nulls, empty and long texts, ties and repeated rows as the function
    that it calls says; an empty table gives an empty one.
    """
    return quality_rules.keep_good(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble takes for good.

    It learns from labelled rows of the whole corpus: nearly all that are labelled bad are
    gone from ``docs``.
    """
    corpus = table(spark, sf_dir, "documents")
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"), corpus)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of least id."""
    return near_dedup.keep_one(docs, SHINGLE_WORDS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs, word_vocabulary(), with_ids=False, forget=True)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: The classifier and the packing have no form in SQL; tests hold the stages against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
