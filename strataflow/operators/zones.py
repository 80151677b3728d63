"""Zone lists, regions and the atlas that stacks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import crop_excluding, rect, to_ndc, uses_shader

MAX_ZONES = 6
# Fixed value: the place of an added zone (left, top, right, bottom).
ADDITIONAL = (0.35, 0.44, 0.65, 0.56)


def atlas(layers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, width, height -> atlas_row of every layer and the atlas size. Null layers (no width) drop out, and
    where the columns region_width and region_height are given, layers of another size than their region."""
    there = layers.where("width is not null")
    if {"region_width", "region_height"} <= set(layers.columns):
        there = there.where("width = region_width and height = region_height")
    above = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return there.select(*keys, "pos", "width", "height", F.coalesce(F.sum("height").over(above), F.lit(0)).alias("atlas_row"), F.greatest(F.max("width").over(whole), F.lit(1)).alias("atlas_width"), F.greatest(F.sum("height").over(whole), F.lit(1)).alias("atlas_height"))


def lookup(zones: DataFrame, regions: DataFrame) -> DataFrame:
    """First usable region of every zone, zeros without one. Regions are reduced to one row per zone first."""
    first = regions.where("mask_pixels > 0").groupBy("zone_id").agg(F.min_by(F.struct("left", "top", "width", "height"), "pos").alias("r"))
    got = zones.join(first, "zone_id", "left")
    return got.select("zone_id", *(F.coalesce(F.col(f"r.{c}"), F.lit(0)).alias(c) for c in ("left", "top", "width", "height")))


def offsets(zones: DataFrame, regions: DataFrame) -> DataFrame:
    """Atlas row of every zone's first region, whether it is usable or not; 0 without one."""
    first = regions.groupBy("zone_id").agg(F.min_by("atlas_row", "pos").alias("_row"))
    return zones.join(first, "zone_id", "left").select("zone_id", F.coalesce("_row", F.lit(0)).alias("atlas_row"))


def restorable(regions: DataFrame) -> DataFrame:
    """The region that each zone's restorer works on: of the usable ones the last."""
    return regions.where("mask_pixels > 0").groupBy("zone_id").agg(F.max("pos").alias("pos"))


def preview_routes(zones: DataFrame, regions: DataFrame, method: Column, same_size: Column) -> DataFrame:
    """zones (zone_id, ..) with the route of each in a preview: restored where a usable region covers it, drawn by the
    spatial kernels elsewhere, and the source as it is for methods that draw nothing."""
    usable = regions.where("mask_pixels > 0").select("zone_id").distinct().withColumn("_usable", F.lit(True))
    kept = F.coalesce("_usable", F.lit(False)) & (method == "INPAINT") & same_size
    return zones.join(usable, "zone_id", "left").withColumn("route", F.when(~uses_shader(method), "source").when(kept, "restored").otherwise("shader")).drop("_usable")


def effects(zones: DataFrame, keys: list[str], method: Column) -> DataFrame:
    """keys, effect, rect: of the zones (keys, pos, r, ..) of an edit, the crop around its first zone, or the removal of all."""
    got = zones.withColumn("_m", method).groupBy(*keys).agg(F.min_by("r", "pos").alias("_first"), F.min_by("_m", "pos").alias("_m"), F.count(F.lit(1)).alias("_n"))
    crop = F.col("_m") == "CROP"
    return got.select(*keys, F.when(crop, "crop").otherwise("removal").alias("effect"), F.least(F.col("_n"), F.lit(MAX_ZONES)).alias("zones"), F.when(crop, to_ndc(crop_excluding(F.col("_first")))).alias("rect"))


def add_zone(zones: DataFrame, keys: list[str]) -> DataFrame:
    """zones (keys, zone_id, pos, r) with one more at the default place for every list, under the next number."""
    le, t, r, b = ADDITIONAL
    new = zones.groupBy(*keys).agg((F.max("zone_id") + 1).alias("zone_id"), (F.max("pos") + 1).alias("pos")).withColumn("r", rect(*map(F.lit, (le, t, r, b))))
    return zones.select(*keys, "zone_id", "pos", "r").unionByName(new)


def remove_zone(zones: DataFrame, keys: list[str], selected: Column) -> DataFrame:
    """Lists without their selected zone, and whether a zone is selected then: the last one."""
    left = zones.where(~F.coalesce(selected, F.lit(False)))
    last = F.max("pos").over(Window.partitionBy(*keys))
    return left.withColumn("selected", F.col("pos") == last)


def current_results(results: DataFrame, edits: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Results of the video and zones that are still being edited; stale ones drop out."""
    return results.join(edits.select(*keys, version).distinct(), [*keys, version], "left_semi")


def remaining(zones: DataFrame, regions: DataFrame) -> DataFrame:
    """Zones that no usable region covers."""
    return zones.join(regions.where("mask_pixels > 0").select("zone_id"), "zone_id", "left_anti")


def numbered(rows: DataFrame, order: str, keys: list[str] | None = None, ranges: int = 64) -> DataFrame:
    """rows with pos, their place from 0 in the order of a numeric column within their list. Without keys the rows are
    one list: it is cut at fixed bounds (approximate quantiles) into ranges that number their own rows, and
    what stands before each range is added from its count, so no task ever holds the list."""
    if keys:
        return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long") - 1)
    bounds = sorted(set(rows.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.01)))
    cut = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    placed = rows.withColumn("_p", cut)
    inside = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(order)).cast("long") - 1)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", before.alias("_b"))
    return inside.join(F.broadcast(counts), "_p").withColumn("pos", F.col("_b") + F.col("_k")).drop("_p", "_k", "_b")  # a row a range


def positional(zones: DataFrame, layers: DataFrame) -> DataFrame:
    """Joins two numbered lists by place; the shorter one ends it."""
    return zones.join(layers, "pos")


def first_zones(zones: DataFrame, keys: list[str], most: int = MAX_ZONES) -> DataFrame:
    return zones.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).where(F.col("_r") <= most).drop("_r")
