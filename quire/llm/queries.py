"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import chat, decontaminate, divergence, hard_negatives, jaccard, langid, mixing, packing, secrets, substrings, token_counts, topk
from quire.llm.common import bound_batches, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table, in Arrow batches that hold long texts in bounded memory."""
    bound_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digest(found)


def op2_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_matrices(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_exact_complement(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats_digest(substrings.remove_repeats(documents(spark, sf_dir)))


def op5_embedding_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.embedding_top_k(table(spark, sf_dir, "embeddings"))


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_digest(chat.format_preferences(chat.paired(table(spark, sf_dir, "conversations"))))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(secrets.scan_secrets(documents(spark, sf_dir)))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(documents(spark, sf_dir), budget=token_counts.LIMIT)
    return token_counts.over_limit(counted).withColumnsRenamed({"budget_chars": "limit_chars", "budget_tokens": "limit_tokens"})


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.embedding_hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(mixing.mixed(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_token_matrices, op3_best_fit_packing, op4_substring_dedup, op5_embedding_top_k, op6_preferences, op7_secret_scan,
        op8_token_counts, op9_jaccard_join, op10_language_id, op11_source_divergence, op12_hard_negatives, op13_source_mix,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.CONTAMINATION_SQL,
    "op4_substring_dedup": substrings.REPEATS_SQL,
    "op5_embedding_top_k": topk.EMBEDDING_TOP_K_SQL,
    "op6_preferences": chat.PREFERENCE_SQL,
    "op9_jaccard_join": jaccard.JACCARD_SQL,
    "op11_source_divergence": divergence.DIVERGENCE_SQL,
    "op12_hard_negatives": hard_negatives.HARD_NEGATIVES_SQL,
    "op13_source_mix": mixing.MIXING_SQL,
}
