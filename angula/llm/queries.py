"""The queries of this subpackage, over whole tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, jaccard, licences, lines, merkle, mix, neighbours, ngram_lm, pii, secrets, tokens, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.scores(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixed_sizes(table(spark, sf_dir, "documents")).drop("source")


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.links(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


def op12_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.checked(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_licence_scan": op1_licence_scan,
    "op2_lm_scores": op2_lm_scores,
    "op3_token_counts": op3_token_counts,
    "op4_secret_scan": op4_secret_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_source_mix": op7_source_mix,
    "op8_near_vectors": op8_near_vectors,
    "op9_toxicity": op9_toxicity,
    "op10_benchmark_leaks": op10_benchmark_leaks,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_pii_scan": op12_pii_scan,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE: dict[str, str] = {
    "op6_jaccard_join": jaccard.oracle(),
    "op7_source_mix": mix.oracle(),
    "op8_near_vectors": neighbours.oracle(),
    "op11_merkle_manifest": merkle.oracle(),
}
