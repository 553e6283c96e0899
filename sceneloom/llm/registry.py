"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, embedding_dedup, lm_scoring, mixing, periodic_runs, quality, secrets, sharding, simhash, sql, suffix_dedup, token_counts, url_rules
from .common import Scratch, table


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_rules(table(spark, sf_dir, "documents"), Scratch(spark, "op6"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), Scratch(spark, "op3"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.redacted_counts(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op8")).drop("source")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_loops(table(spark, sf_dir, "documents"))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.digests(conversation_repair.repaired(rows, Scratch(spark, "op12")))


def op13_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "op13"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_secret_scan, op3_url_rules, op4_decontaminate, op5_hilbert_shards, op6_quality_rules, op7_token_counts, op8_mix_sources, op9_suffix_dedup, op10_simhash_near_duplicates, op11_periodic_runs, op12_conversation_repair, op13_embedding_near_duplicates)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_rules": sql.url_rules_sql(url_rules.HOST_RULES, url_rules.PATTERN_RULES, url_rules.DEFAULT),
        "op6_quality_rules": sql.QUALITY_RULES,
        "op8_mix_sources": sql.mixing_sql(mixing.WEIGHTS, mixing.MOST_REPEATS, mixing.BLOCK, mixing.SEED, mixing.SHARDS),
        "op12_conversation_repair": sql.conversation_repair_sql(conversation_repair.STEPS, conversation_repair.ENDS),
        "op13_embedding_near_duplicates": sql.embedding_dedup_sql(embedding_dedup.LEAST_COSINE),
    }
