"""One query per operator, over its whole table, with its production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm import (
    bpe,
    chat_tree,
    context_tree,
    conversation_trie,
    near_dedup,
    packing,
    personal_data,
    quality_classifier,
    quality_rules,
    sharding,
    token_alignment,
    topk_search,
    url_filter,
)
from garimpo.llm.checks import ORACLE_SQL  # noqa: F401  read by __spark_entry__
from garimpo.llm.common import table


def word_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, word_vocabulary(), with_ids=False)


def op6_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are made of control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    hard = spark.createDataFrame(more, "conv_id bigint, turn bigint, role string, text string")
    return chat_tree.read_back(chat_tree.pack_conversations(turns.unionByName(hard)))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a layout by source, where one shard holds a third of the bytes, to equal ones."""
    docs = table(spark, sf_dir, "documents")
    source = F.coalesce(F.col("source").cast("binary"), F.lit(b""))
    return sharding.reshard_documents(docs, F.crc32(source) % sharding.OLD_SHARDS)


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_running(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, word_vocabulary(), with_ids=False)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
        with_groups=False,
    )


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"), with_texts=False)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_chat_tree": op6_chat_tree,
    "op7_topk_search": op7_topk_search,
    "op8_sharding": op8_sharding,
    "op9_context_tree": op9_context_tree,
    "op10_bpe": op10_bpe,
    "op11_token_alignment": op11_token_alignment,
    "op12_personal_data": op12_personal_data,
    "op13_conversation_trie": op13_conversation_trie,
}
