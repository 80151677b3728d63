"""Corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes and rereads every
result as Parquet, as the next stage's docs. All stages but the last return the columns of documents,
extra ones of any name included, and an empty table for an empty table.
No stage is expressed by SQL as a whole (compression ratios, token ids), so the pipeline is tested
against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import decontaminate, jaccard_join, packing, quality_rules, suffix_dedup
from strataflow.llm.queries import ship, table, tokenizer_path
from strataflow.llm.shared import columns_of, doc_key, free_names, written

ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and wordless texts always, repeated rows all or none, a null id
    as any other; a verdict depends on the text alone, so there are no ties."""
    ship(spark)
    return quality_rules.filter_documents(docs)


#: Keys of removed documents are broadcast up to this count (8 bytes each), and joined by shuffle beyond.
BROADCAST_KEYS = 2_000_000


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id stays (null ids last, of
    repeated rows one); documents that link with nothing all stay, null, empty and wordless texts among them."""
    ship(spark)
    found = jaccard_join.join_documents(docs).where("group is not null").select("key", "doc_id", "group")
    found = written(found, "linked")
    (key,) = free_names(docs, "_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key"))
    stays = found.groupBy("group").agg(first.getField("key").alias("key")).select("key")
    gone = written(found.select("key").distinct().join(stays, "key", "left_anti").withColumnRenamed("key", key), "gone")
    keys = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    kept = docs.withColumn(key, doc_key()).join(keys, key, "left_anti")
    twice = found.groupBy("key").count().where("count > 1").join(stays, "key", "left_semi").select(F.col("key").alias(key))
    if not twice.limit(1).count():
        return kept.select(*columns_of(docs))
    single, repeated = kept.join(twice, key, "left_anti"), kept.join(twice, key, "left_semi").dropDuplicates([key])
    return single.unionByName(repeated).select(*columns_of(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that occur elsewhere go; documents stay, n_chars follows. Null texts stay null, texts
    under 200 bytes as they are; repeated rows are repeats of each other, and no copy is spared; bytes of a
    character that was cut become U+FFFD."""
    ship(spark)
    out = suffix_dedup.dedup_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null, empty and wordless texts and items match nothing; repeated
    documents go all or none; without items every document stays."""
    ship(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified. Null and empty texts are one piece of the
    end id; repeated rows are packed as often as they occur; of pieces of equal length any may stand first."""
    ship(spark)
    pieces = packing.token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, seq_len=2048)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), seq_len=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
