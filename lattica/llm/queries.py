"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, chat, decontaminate, exact_dedup, hard_negatives, lexical, licenses, quality, sharding, simhash, suffix_dedup, suffix_tree, toxicity
from lattica.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_digests(decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).drop("row_no")


#: A limit that splits small tables too.
SMALL = 64 << 10


def sharding_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op7_sharding`` with a limit that makes many shards of any table."""
    return sharding.shard(table(spark, sf_dir, "documents"), SMALL).drop("row_no")


def sharding_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by source, of which there are few and one is hot: such buckets go on by the bits of the row."""
    cut = sharding.shard(table(spark, sf_dir, "documents"), SMALL, "source", row=F.col("doc_id"))
    return cut.withColumnsRenamed({"doc_id": "source", "row_no": "doc_id"})


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_chats(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.substring_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_decontaminate, op4_quality, op5_exact_dedup, op6_simhash, op7_sharding, sharding_small, sharding_hot_keys, op8_bpe, op9_chat, op10_licenses, op11_hard_negatives, op12_lexical_search, op13_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": decontaminate.ORACLE_SQL,
        "op5_exact_dedup": exact_dedup.ORACLE_SQL,
        "op7_sharding": sharding.ORACLE_SQL,
        "sharding_small": sharding.oracle(SMALL),
        "sharding_hot_keys": sharding.oracle(SMALL, "source", "doc_id"),
        "op9_chat": chat.ORACLE_SQL,
        "op10_licenses": licenses.ORACLE_SQL,
        "op11_hard_negatives": hard_negatives.ORACLE_SQL,
        "op12_lexical_search": lexical.ORACLE_SQL,
        "op13_substring_dedup": suffix_tree.ORACLE_SQL,
    }
