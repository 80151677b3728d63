"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conv_quality, dac, decontaminate, html_text, jaccard_join, license_scan, oracles, packing, quality_rules, quote_chat, suffix_dedup


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession) -> None:
    """Python workers of a session that was started elsewhere find this package where the driver did."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = dac.token_file(spark, "op1")
    dac.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return dac.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "first_id", "last_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, seq_len=2048)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digest, seq_len=2048)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(table(spark, sf_dir, "documents"), k=5, percent=80).select("doc_id", "n_shingles", "component_id", "n_links")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op6_quotation_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_chat.format_conversations(table(spark, sf_dir, "conversations"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.removed_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_byte_conv_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return conv_quality.score_documents(docs, conv_quality.train(docs, table(spark, sf_dir, "labels")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start_word", "n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_codes": op1_token_codes,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_html_extraction": op5_html_extraction,
    "op6_quotation_chat": op6_quotation_chat,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_byte_conv_quality": op8_byte_conv_quality,
    "op9_license_scan": op9_license_scan,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}
ORACLES: dict[str, str] = {
    "op4_ngram_jaccard_join": oracles.JACCARD,
    "op9_license_scan": oracles.LICENSES,
    "op10_benchmark_decontamination": oracles.LEAKS,
}
