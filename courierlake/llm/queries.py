"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_sentencepiece, bwt_dedup, chat_spans, conversation_repair, cover_dedup, decontaminate, html_blocks, ngram_join, oracles, pii_spans, quality_fm, quality_rules, spelling_variants, warc_normalise
from .shared import settled

RANKS = "byte_bpe_50k.tiktoken"
PLANTED_CHAT = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def benchmark_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items share a template; op1 names each template by its smallest item."""
    return decontaminate.template_classes(table(spark, sf_dir, "benchmark"))


def op2_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op4_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: cover_dedup.remove_repeats_digest(table(spark, sf_dir, "documents")))


def op5_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_sentencepiece.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_distribution_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("n_chars", "char_distance", "word_distance")


def op7_bwt_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: bwt_dedup.remove_common_digest(table(spark, sf_dir, "documents")))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: ngram_join.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "rep", "n_links", "n_text_links"))


def op9_chat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED_CHAT), (-7, 1, "assistant", PLANTED_CHAT)], rows.schema)
    return chat_spans.digests(chat_spans.format_chats(rows.unionByName(planted)))


def op10_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_normalise.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: pii_spans.digests(pii_spans.find(table(spark, sf_dir, "documents"))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: spelling_variants.variants(table(spark, sf_dir, "documents")))


def op13_bucket_queue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: conversation_repair.repair(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_template_leaks, op2_factorisation_machine, op3_html_blocks, op4_cover_anchors, op5_sentencepiece_bpe, op6_distribution_rules, op7_bwt_intervals, op8_ngram_jaccard, op9_chat_spans, op10_warc_normaliser, op11_weak_supervision, op12_spelling_variants, op13_bucket_queue_repair, benchmark_classes, pipeline)}


def oracle_sql() -> dict[str, str]:
    """op1 (look-behind patterns), op2 (training), op3 (a scanner) and op5 (merges) have none; tests hold them against plain Python."""
    return {
        "op4_cover_anchors": oracles.repeated_windows(),
        "op6_distribution_rules": oracles.divergence(),
        "op7_bwt_intervals": oracles.common_bytes(),
        "op8_ngram_jaccard": oracles.jaccard(),
        "op9_chat_spans": oracles.chats(PLANTED_CHAT),
        "op10_warc_normaliser": oracles.warc(),
        "op12_spelling_variants": oracles.spelling(),
        "op13_bucket_queue_repair": oracles.repairs(),
    }
