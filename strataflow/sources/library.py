"""The JSON library index: {"version": 1, "items": [...]} with tolerant reading and keyed edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import display_name, safe_name

# The keys of an index entry in file order, and the methods it may name.
ITEM = "id: bigint, uri: string, name: string, source: string, createdAt: bigint, durationMs: bigint, width: int, height: int, size: bigint, method: string, zones: int, thumb: string"
ENVELOPE = f"struct<version: int, items: array<struct<{ITEM}>>>"
METHODS = ["INPAINT", "BLUR", "PIXELATE", "CROP"]


def decode_items(json: Column) -> Column:
    """array of entries; text that isn't an index gives none, entries without id or uri drop out."""
    items = F.from_json(json, ENVELOPE, {"mode": "PERMISSIVE"}).getField("items")
    return F.filter(F.coalesce(items, F.array().cast(f"array<struct<{ITEM}>>")), lambda x: x.isNotNull() & x.id.isNotNull() & x.uri.isNotNull())


def with_defaults(rows: DataFrame) -> DataFrame:
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in ("name", "source")}
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("createdAt", "durationMs", "width", "height", "size", "zones")}
    return rows.withColumns({**blank, **zero, "method": F.when(F.col("method").isin(METHODS), F.col("method")).otherwise("INPAINT")})


def decode(rows: DataFrame, json: str) -> DataFrame:
    return with_defaults(rows.select(F.inline(decode_items(F.col(json)))))


def encode(items: DataFrame) -> DataFrame:
    """One row per entry: its JSON object, with a null thumbnail written as null."""
    return items.select("id", F.to_json(F.struct(*(F.col(c.split(":")[0].strip()) for c in ITEM.split(","))), {"ignoreNullFields": "false"}).alias("json"))


def envelope(items: DataFrame) -> DataFrame:
    """The whole index as one JSON text; an index is a user's own list and small."""
    ordered = F.array_sort(F.collect_list(F.struct("id", F.struct(*(F.col(c.split(":")[0].strip()) for c in ITEM.split(","))).alias("e"))))
    return items.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.transform(ordered, lambda x: x.e).alias("items")), {"ignoreNullFields": "false"}).alias("json"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.text(path, wholetext=True), "value")


def write_index(items: DataFrame, path: str) -> None:
    """Spark's committer swaps the new index in as a whole."""
    envelope(items).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def prune(items: DataFrame, alive: DataFrame, key: str = "uri") -> DataFrame:
    """Entries whose file is there."""
    return items.join(alive.select(key).distinct(), key, "left_semi")


def pruned(items: DataFrame, alive: DataFrame, key: str = "uri") -> DataFrame:
    return items.join(alive.select(key).distinct(), key, "left_anti")


def rename(items: DataFrame, key: Column, name: Column) -> DataFrame:
    """Entries told by key get a typed name, made safe; a blank one keeps the old name as its base."""
    typed = F.when(F.trim(F.coalesce(name, F.lit(""))) == "", F.col("name")).otherwise(name)
    return items.withColumn("name", F.when(key, F.concat(safe_name(typed), F.lit(".mp4"))).otherwise(F.col("name")))


def exported(rows: DataFrame) -> DataFrame:
    """Index entries of exports (id, uri, source, duration_ms and source_duration_ms, width, height, size, method, zones,
    thumb): named after their source, and as long as it where the export tells no duration."""
    long = F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(F.col("source_duration_ms"))
    return rows.select(
        "id", "uri", display_name(F.col("source")).alias("name"), "source", F.col("id").alias("createdAt"), long.cast("long").alias("durationMs"),
        "width", "height", "size", "method", "zones", "thumb",
    )


def recent(items: DataFrame, most: int = 8) -> DataFrame:
    return items.orderBy(F.desc("createdAt"), F.desc("id")).limit(most)
