"""Neighbourhood operators as windows over rows and columns: no self-joins where a window will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import median_mad

TAU_GRADIENT, K_CONSISTENT = 0.02, 2.0


def gradients(frames: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """keys, y, x, d: difference to the next pixel along the axis; the last has none."""
    other = "y" if axis == "x" else "x"
    w = Window.partitionBy(*keys, other).orderBy(axis)
    return frames.withColumn("d", F.lead("v").over(w) - F.col("v")).where("d is not null").drop("v")


def temporal_gradient(frames: DataFrame, clip: list[str], axis: str) -> DataFrame:
    """clip, y, x, med, mad of the gradients over all frames t of a clip."""
    return median_mad(gradients(frames, [*clip, "t"], axis), [*clip, "y", "x"], "d")


def consistent_gradient(frames: DataFrame, clip: list[str], axis: str) -> DataFrame:
    """The median gradient where frames agree on it, else 0."""
    got = temporal_gradient(frames, clip, axis)
    agree = (F.abs("med") > TAU_GRADIENT) & (F.abs("med") > K_CONSISTENT * F.col("mad"))
    return got.select(*clip, "y", "x", F.when(agree, F.col("med")).otherwise(0.0).alias("g"))


def significant_gradient(frames: DataFrame, mask: DataFrame, clip: list[str], axis: str) -> DataFrame:
    """The median gradient of edges with an end in the mask, where it exceeds its own noise."""
    got = frames.select(*clip, "t").distinct().groupBy(*clip).agg(F.count(F.lit(1)).alias("n")).join(temporal_gradient(frames, clip, axis), clip)
    other = "y" if axis == "x" else "x"
    near = mask.withColumn("touch", F.greatest(F.col("m"), F.coalesce(F.lead("m").over(Window.partitionBy(*clip, other).orderBy(axis)), F.lit(0))))
    keep = F.abs("med") > 2 * 1.25 / F.sqrt("n") * F.col("mad")
    return got.join(near.where("touch = 1").select(*clip, "y", "x"), [*clip, "y", "x"]).select(*clip, "y", "x", F.when(keep, F.col("med")).otherwise(0.0).alias("g"))


def gradient_energy(frames: DataFrame, clip: list[str]) -> DataFrame:
    """clip, y, x, energy: squared consistent gradients, each edge credited to both ends."""
    parts = None
    for axis in ("x", "y"):
        g = consistent_gradient(frames, clip, axis).where("g <> 0")
        ends = g.select(*clip, F.explode(F.array(F.struct("y", "x"), F.struct((F.col("y") + int(axis == "y")).alias("y"), (F.col("x") + int(axis == "x")).alias("x")))).alias("e"), (F.col("g") * F.col("g")).alias("s"))
        parts = ends if parts is None else parts.unionByName(ends)
    return parts.groupBy(*clip, F.col("e.y").alias("y"), F.col("e.x").alias("x")).agg(F.sum("s").alias("energy"))


def _both(rows: DataFrame, keys: list[str], r: int, agg, source: str, out: str) -> DataFrame:
    across = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(-r, r)
    down = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(-r, r)
    return rows.withColumn(out, agg(source).over(across)).withColumn(out, agg(out).over(down))


def local_range(rows: DataFrame, keys: list[str], r: int) -> DataFrame:
    """keys, y, x, span: most minus least in the (2r + 1)-square, cut off at the borders; rows first, then columns."""
    got = _both(_both(rows, keys, r, F.max, "v", "_hi"), keys, r, F.min, "v", "_lo")
    return got.select(*keys, "y", "x", (F.col("_hi") - F.col("_lo")).alias("span"))


def dilate(mask: DataFrame, keys: list[str], r: int = 1) -> DataFrame:
    """8-connected dilation of the 0/1 column m."""
    return _both(mask, keys, r, F.max, "m", "m").select(*keys, "y", "x", "m")


def masked_median(rows: DataFrame, keys: list[str]) -> DataFrame:
    """3x3 median of the values >= 0, at places that have one and three or more around; else -1."""
    valid = rows.where("v >= 0")
    spread = valid.select(*keys, F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)).alias("y"), "x", "v").select(*keys, "y", F.explode(F.sequence(F.col("x") - 1, F.col("x") + 1)).alias("x"), "v")
    found = spread.groupBy(*keys, "y", "x").agg(F.count("v").alias("k"), F.median("v").alias("m"))
    kept = rows.join(found, [*keys, "y", "x"], "left")
    return kept.select(*keys, "y", "x", F.when((F.col("v") >= 0) & (F.col("k") >= 3), F.col("m")).otherwise(-1.0).alias("v"))


def fill_distances(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of every fill pixel (m = 1) to the nearest other pixel left, right, up and down: 255
    where there is none; 0 on pixels that aren't fill."""
    out = mask
    for name, axis, other, ahead in (("dl", "x", "y", False), ("dr", "x", "y", True), ("du", "y", "x", False), ("dd", "y", "x", True)):
        w = Window.partitionBy(*keys, other).orderBy(F.desc(axis) if ahead else F.asc(axis))
        seen = F.last(F.when(F.col("m") == 0, F.col(axis)), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(name, F.when(F.col("m") == 0, 0).otherwise(F.least(F.coalesce(F.abs(F.col(axis) - seen), F.lit(255)), F.lit(255))))
    return out


def directional_nearest(mask: DataFrame, keys: list[str]) -> DataFrame:
    """First clean pixel (m = 0) left, right, up and down of every masked pixel; -1 without one."""
    out = mask
    for name, axis, other, ahead in (("left", "x", "y", False), ("right", "x", "y", True), ("up", "y", "x", False), ("down", "y", "x", True)):
        w = Window.partitionBy(*keys, other).orderBy(F.desc(axis) if ahead else F.asc(axis)).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(name, F.coalesce(F.last(F.when(F.col("m") == 0, F.col(axis)), True).over(w), F.lit(-1)))
    return out.where("m = 1").drop("m")


def weighted_blur(rows: DataFrame, keys: list[str], w: int, h: int, radius: int = 4, falloff: float = 10.0) -> DataFrame:
    """Gaussian blur with clamped reads. The kernel exp(-d^2 / falloff) is a product of two one-dimensional
    kernels, so columns follow rows: 2 (2r + 1) taps a pixel instead of (2r + 1)^2."""
    out = rows
    for axis, size in (("x", w), ("y", h)):
        taps = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("k")
        spread = out.select(*keys, "y", "x", "v", taps)
        # Source pixel s feeds target s - k; a border pixel also feeds all targets that would read beyond it.
        reach = F.when((F.col(axis) == 0) & (F.col("k") < 0), F.sequence(F.lit(0), F.least(-F.col("k"), F.lit(size - 1))))
        reach = reach.when((F.col(axis) == size - 1) & (F.col("k") > 0), F.sequence(F.greatest(F.lit(size - 1) - F.col("k"), F.lit(0)), F.lit(size - 1)))
        reach = reach.otherwise(F.when((F.col(axis) - F.col("k")).between(0, size - 1), F.array(F.col(axis) - F.col("k"))))
        fed = spread.withColumn("_to", F.explode(reach)).withColumn("_w", F.exp(-F.pow(F.col("k"), 2) / falloff))
        other = "y" if axis == "x" else "x"
        out = fed.groupBy(*keys, other, F.col("_to").alias(axis)).agg((F.sum(F.col("v") * F.col("_w")) / F.sum("_w")).alias("v"))
    return out.select(*keys, "y", "x", "v")


def pixelate(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Every pixel takes the value at the centre of its block (the last pixel there at the borders)."""
    at = Window.partitionBy(*keys, F.floor(F.col("y") / block), F.floor(F.col("x") / block))
    marked = rows.withColumns({"_my": F.max(F.col("y") % block).over(at), "_mx": F.max(F.col("x") % block).over(at)})
    hit = (F.col("y") % block == F.least(F.lit(block // 2), F.col("_my"))) & (F.col("x") % block == F.least(F.lit(block // 2), F.col("_mx")))
    return marked.withColumn("v", F.max(F.when(hit, F.col("v"))).over(at)).select(*keys, "y", "x", "v")
