"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sitegauge.llm import (
    contamination, divergence, licenses, line_dedup, mil, ngram_join, packing, periodic, quality_rules, rans, suffix_dedup, toxicity,
    virtual_slots,
)
from sitegauge.llm.common import table


def op1_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents, with a lexicon learned outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    return mil.judge(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic"), 0.7)


def op2_parsed_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes covered by 400-byte strings that occur more than once."""
    return suffix_dedup.digest(suffix_dedup.dedup(table(spark, sf_dir, "documents")))


def op3_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents, learned outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    return mil.judge(docs, mil.fit(docs, table(spark, sf_dir, "labels"), "quality"), 0.5)


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item of which a document holds 80 % or more of the 5-word shingles."""
    return contamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that stay after equal and neighbouring earlier lines are taken out."""
    done = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base verdict and verdict of the newest policy for all documents."""
    judged = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), max(quality_rules.POLICIES))
    base = judged["failed_bits"].bitwiseAND(quality_rules.mask(1)) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence occurrence in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a similarity of 0.9 or more."""
    return ngram_join.link(table(spark, sf_dir, "documents"))


def op9_rans_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token ids of all documents as shards and reports each document as decoded from them."""
    folder = rans.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rans.read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes, by virtual slots."""
    placed = virtual_slots.shard(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all pairs of sources of a language, and the terms each source prefers."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, with the planted ones, and the texts without them."""
    return periodic.digest(periodic.collapse(periodic.planted(table(spark, sf_dir, "documents"))))


OPERATORS = (
    op1_lexicon_toxicity, op2_parsed_repeats, op3_attention_quality, op4_benchmark_leaks, op5_line_neighbours, op6_rule_ledger,
    op7_license_scan, op8_ngram_components, op9_rans_shards, op10_cost_packing, op11_virtual_slots, op12_source_divergence,
    op13_periodic_runs,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op12_source_divergence": divergence.ORACLE_SQL, "op4_benchmark_leaks": contamination.ORACLE_SQL, "op5_line_neighbours": line_dedup.ORACLE_SQL, "op6_rule_ledger": quality_rules.ORACLE_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
